"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

Readings are reduced to one value per (series, day), then to one row per series holding its days
as arrays: at most one entry per day of the time axis, whatever the number of readings.  The rest
works on these rows.  Per frequency, the series-by-period matrix is factorised by alternating
least squares: a series' factor needs only its own row and the period factors; the period factors
need per-period sums over series, which partial aggregates reduce before the shuffle.  What reaches
the driver are the period factors, bounded by the length of the time axis and never by the number
of series.  Observed cells stay exact; a missing cell without support stays marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date
from kronopanel.session import materialize

FREQUENCIES = ("daily", "weekly", "monthly", "quarterly")
#: The spellings of a frequency, after lower-casing and trimming.
SPELLINGS = {
    "daily": ("daily", "day", "d"),
    "weekly": ("weekly", "week", "w"),
    "monthly": ("monthly", "month", "m"),
    "quarterly": ("quarterly", "quarter", "q"),
}
RANK = 3
_RIDGE = 0.05


def frequency_code(text: Column) -> Column:
    """0 daily, 1 weekly, 2 monthly, 3 quarterly; NULL for anything else."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[\s\-_.]+", "")
    out = F.lit(None).cast("int")
    for code, name in enumerate(FREQUENCIES):
        out = F.when(t.isin(*SPELLINGS[name]), F.lit(code)).otherwise(out)
    return out


def _periods(days: np.ndarray, freq: int) -> np.ndarray:
    """Period index of each day (days since 1970-01-01)."""
    if freq == 0:
        return days
    if freq == 1:
        return (days + 3) // 7
    month = days.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    return month if freq == 2 else month // 3


def _starts(periods: np.ndarray, freq: int) -> np.ndarray:
    """First day of each period, as days since 1970-01-01."""
    if freq == 0:
        return periods
    if freq == 1:
        return periods * 7 - 3
    return (periods * (1 if freq == 2 else 3)).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


def series_rows(readings: DataFrame, *, series: str, period: str, frequency: str, value: str, loaded: str) -> DataFrame:
    """One row per series: frequency code, days with a value, their values (the last loaded of a day)."""
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    r = readings.select(F.col(series).cast("string").alias("s"), frequency_code(F.col(frequency)).alias("f"), F.unix_date(flexible_date(F.col(period).cast("string"))).alias("day"), number.alias("x"), F.col(loaded).alias("at"))
    r = r.where("s is not null")
    votes = [F.sum(F.when(F.col("f") == c, 1).otherwise(0)).alias(f"f{c}") for c in range(4)]
    order = F.when(F.col("x").isNotNull() & F.col("day").isNotNull(), F.struct("at", "x"))
    per_day = r.groupBy("s", "day").agg(F.max_by("x", order).alias("x"), F.max(F.when(F.col("x").isNotNull(), 1).otherwise(0)).alias("has"), *votes)
    per_series = per_day.groupBy("s").agg(
        F.sort_array(F.collect_list(F.when((F.col("has") == 1) & F.col("day").isNotNull(), F.struct("day", "x")))).alias("cells"),
        *[F.sum(f"f{c}").alias(f"f{c}") for c in range(4)],
    )
    best = F.greatest(*[F.col(f"f{c}") for c in range(4)])
    code = F.lit(None).cast("int")
    for c in (3, 2, 1, 0):  # a tie goes to the finer frequency
        code = F.when((F.col(f"f{c}") == best) & (best > 0), F.lit(c)).otherwise(code)
    return per_series.where(F.size("cells") > 0).select("s", code.alias("f"), F.col("cells.day").alias("day"), F.col("cells.x").alias("x")).where("f is not null")


def _cells(day: np.ndarray, x: np.ndarray, freq: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods with a value and the mean of their days' values."""
    p, inverse, n = np.unique(_periods(np.asarray(day, np.int64), freq), return_inverse=True, return_counts=True)
    return p, np.bincount(inverse, weights=np.asarray(x, float)) / n


def _scaled(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    finite = np.isfinite(x)
    mean = float(x[finite].mean()) if finite.any() else 0.0
    scale = float(x[finite].std()) if finite.any() else 0.0
    scale = scale if np.isfinite(scale) and scale > 0 else 1.0
    return np.where(finite, (x - mean) / scale, 0.0), mean, scale


def _first_factors(periods: np.ndarray, freq: int) -> np.ndarray:
    """A smooth deterministic start: level, trend, yearly wave."""
    per_year = (365.25, 52.18, 12.0, 4.0)[freq]
    t = periods.astype(float)
    span = max(1.0, float(np.ptp(t)))
    return np.stack([np.ones_like(t), (t - t.mean()) / span * 2, np.sin(2 * np.pi * t / per_year)], axis=1)[:, :RANK]


def _source_factor(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.linalg.solve(v.T @ v + _RIDGE * len(z) ** 0.5 * np.eye(v.shape[1]), v.T @ z)


def _trust(p: np.ndarray, z: np.ndarray, fit: np.ndarray) -> float:
    """How far the fit helps to tell an observed cell from its neighbours, by least squares over them: 0 not at all, 1 fully."""
    share = (p[1:-1] - p[:-2]) / (p[2:] - p[:-2])
    bend = lambda x: x[1:-1] - (x[:-2] * (1 - share) + x[2:] * share)
    a, b = bend(z), bend(fit)
    return float(np.clip(a @ b / max(b @ b, 1e-12), 0.0, 1.0)) if len(a) else 1.0


class _Factors:
    """Period factors of all frequencies: {frequency: (periods, matrix, support)}."""

    def __init__(self, by_freq: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.by_freq = by_freq

    def rows(self, freq: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, v, support = self.by_freq[freq]
        at = np.minimum(np.searchsorted(known, periods), len(known) - 1)
        hit = known[at] == periods
        return np.where(hit[:, None], v[at], 0.0), np.where(hit, support[at], 0)


def _normal_equations(factors: _Factors):
    """Per-period sums of u u', u z and counts over the series of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        up = np.triu_indices(RANK)
        for pdf in batches:
            for f, day, x in zip(pdf["f"], pdf["day"], pdf["x"]):
                p, y = _cells(day, x, f)
                known = factors.by_freq[f][0]
                z, _, _ = _scaled(y)
                v, _ = factors.rows(f, p)
                u = _source_factor(v, z)
                acc = sums.setdefault(f, np.zeros((len(known), len(up[0]) + RANK + 1)))
                at = np.searchsorted(known, p)
                acc[at, : len(up[0])] += np.outer(u, u)[up]
                acc[at, len(up[0]) : -1] += u * z[:, None]
                acc[at, -1] += 1
        for f, acc in sums.items():
            some = np.flatnonzero(acc[:, -1])
            out = pd.DataFrame(acc[some], columns=[f"a{i}" for i in range(acc.shape[1])])
            out.insert(0, "p", factors.by_freq[f][0][some])
            out.insert(0, "f", f)
            yield out

    return run


def period_factors(rows: DataFrame, rounds: int = 4) -> _Factors:
    """Alternating least squares over all series; returns the period factors."""

    def axis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, set] = {}
        for pdf in batches:
            for f, day in zip(pdf["f"], pdf["day"]):
                seen.setdefault(f, set()).update(np.unique(_periods(np.asarray(day, np.int64), f)).tolist())
        for f, ps in seen.items():
            yield pd.DataFrame({"f": f, "p": sorted(ps)})

    spark = rows.sparkSession
    marks = rows.select("f", "day").mapInPandas(axis, "f int, p long").groupBy("f", "p").count().toPandas()
    by_freq = {}
    for f, g in marks.groupby("f"):
        p = np.sort(g["p"].to_numpy(np.int64))
        by_freq[int(f)] = (p, _first_factors(p, int(f)), np.zeros(len(p), np.int64))
    factors = _Factors(by_freq)
    if not by_freq:
        return factors
    width = RANK * (RANK + 1) // 2 + RANK + 1
    schema = "f int, p long, " + ", ".join(f"a{i} double" for i in range(width))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(factors)
        parts = rows.mapInPandas(lambda it, shared=shared: _normal_equations(shared.value)(it), schema)
        total = parts.groupBy("f", "p").agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in range(width)]).toPandas()
        by_freq = {}
        for f, g in total.groupby("f"):
            g = g.sort_values("p")
            a = g[[f"a{i}" for i in range(width)]].to_numpy()
            m = np.zeros((len(g), RANK, RANK))
            i, j = np.triu_indices(RANK)
            m[:, i, j] = a[:, : len(i)]
            m[:, j, i] = a[:, : len(i)]
            m += _RIDGE * np.eye(RANK)
            by_freq[int(f)] = (g["p"].to_numpy(np.int64), np.linalg.solve(m, a[:, len(i) : -1, None])[:, :, 0], a[:, -1].astype(np.int64))
        factors = _Factors(by_freq)
        shared.unpersist()
    return factors


def regular_grid(
    readings: DataFrame,
    *,
    series: str = "series_key",
    period: str = "period",
    frequency: str = "frequency",
    value: str = "value",
    loaded: str = "loaded_at",
    rounds: int = 4,
    min_support: int = 2,
) -> DataFrame:
    """Each series at its own frequency, one row per period between its first and last with a value.

    Columns: ``series_key, frequency, period_start, value, status``.  ``status`` is 'observed'
    (value exact: the mean of the days' values, a day's value being its last loaded), 'filled'
    (reconstructed by the factorisation, with its residuals at the neighbouring observed periods
    carried over the gap) or 'unsupported' (value NULL: fewer than ``min_support``
    other series were observed in the period, or the series has fewer observed periods than the
    factorisation has ranks).  A series' frequency is the one most of its readings state.

    Defined edge cases: readings without series, readable period or value (NaN is none) do not
    count as observed; a series without any value or any stated frequency gives no row; repeated
    readings change nothing; an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(series_rows(readings, series=series, period=period, frequency=frequency, value=value, loaded=loaded), "series")
    factors = rows.sparkSession.sparkContext.broadcast(period_factors(rows, rounds))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, f, day, x in zip(pdf["s"], pdf["f"], pdf["day"], pdf["x"]):
                p, y = _cells(day, x, f)
                grid = np.arange(p[0], p[-1] + 1)
                at = np.searchsorted(grid, p)
                z, mean, scale = _scaled(y)
                v, support = factors.value.rows(f, grid)
                out, status = np.full(len(grid), np.nan), np.full(len(grid), "unsupported", object)
                if len(p) > RANK:
                    ok = support >= min_support
                    fit = v @ _source_factor(v[at], z)
                    fit *= _trust(p, z, fit[at])
                    # what the factors leave of a source's neighbouring observed cells is carried over the gap
                    out[ok] = (fit + np.interp(grid, p, z - fit[at]))[ok] * scale + mean
                    status[ok] = "filled"
                out[at], status[at] = y, "observed"
                yield pd.DataFrame({"series_key": s, "frequency": FREQUENCIES[f], "day": _starts(grid, f).astype(np.int32), "value": out, "status": status})

    grid = rows.mapInPandas(fill, "series_key string, frequency string, day int, value double, status string")
    return grid.select("series_key", "frequency", F.date_from_unix_date("day").alias("period_start"), F.nanvl("value", F.lit(None).cast("double")).alias("value"), "status")
