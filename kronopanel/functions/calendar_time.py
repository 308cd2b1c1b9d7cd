"""Calendar expressions: month arithmetic, publication lags and tolerant date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(ds: Column) -> Column:
    """Months since year 0; consecutive months differ by one."""
    return F.year(ds) * 12 + F.month(ds)


def month_start(ds: Column) -> Column:
    return F.trunc(ds, "MM")


def step_of(ds: Column, cutoff: Column) -> Column:
    """Forecast step: whole months from ``cutoff`` to ``ds``."""
    return (F.year(ds) - F.year(cutoff)) * 12 + F.month(ds) - F.month(cutoff)


def published_on(period: Column, lag_days: Column | int) -> Column:
    """A period is published ``lag_days`` after its month ends."""
    return F.date_add(F.last_day(period), lag_days)


def latest_published_month(origin: Column, lag_days: Column | int) -> Column:
    """Latest month whose publication date is not after the end of the origin month."""
    day_after = F.date_add(F.date_sub(F.last_day(origin), lag_days), 1)
    return F.add_months(F.trunc(day_after, "MM"), -1)


def flexible_date(text: Column) -> Column:
    """Parse the date notations found in feeds; anything else gives NULL.

    ``YYYY-MM-DD`` (with or without a time), ``YYYY/MM/DD``, ``DD.MM.YYYY``, ``YYYY-MM``,
    ``MM.YYYY`` and ``YYYY-Qn``; a month or quarter stands for its first day.
    """
    s = F.trim(text)
    s = F.regexp_replace(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1")
    s = F.regexp_replace(s, r"^(\d{1,2})\.(\d{4})$", "$2-$1")
    s = F.regexp_replace(s, r"^(\d{4})[/.](\d{1,2})", "$1-$2")
    s = F.regexp_replace(s, r"^(\d{4}-\d{1,2})[/.](\d{1,2})", "$1-$2")
    quarter = F.regexp_extract(s, r"^(\d{4})[- ]?[QqКк]([1-4])$", 2)
    s = F.when(
        quarter != "",
        F.concat(F.substring(s, 1, 4), F.lit("-"), (quarter.try_cast("int") * 3 - 2).cast("string")),
    ).otherwise(s)
    return s.try_cast("date")


def squash_name(text: Column) -> Column:
    """Lower case, trimmed, single blanks (any white space counts)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))
