"""The canonical long panel (series, month, value), its flags, contract and static table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import month_index

#: The categories of the panel; 'total' covers the others.
CATEGORIES = ("total", "food", "health", "transport", "catering", "marketplaces")
TOTAL = "total"


class ContractError(ValueError):
    """The panel breaks its contract."""


def official_panel(consumption: DataFrame) -> DataFrame:
    """``unique_id, territory_id, category, ds, y``: one row per series and month that has a value."""
    rows = consumption.where("value is not null and territory_id is not null").select("territory_id", "category", F.to_date(F.concat("date", F.lit("-01"))).alias("ds"), F.col("value").cast("double").alias("y"))
    one = rows.groupBy("territory_id", "category", "ds").agg(F.max("y").alias("y"))
    return one.select(F.concat_ws("__", F.col("territory_id").cast("string"), "category").alias("unique_id"), "territory_id", "category", "ds", "y")


def rejected_rows(consumption: DataFrame, territories: DataFrame) -> DataFrame:
    """Rows a strict build refuses: ``reason`` and their number."""
    known = territories.select("territory_id").distinct().withColumn("known", F.lit(True))
    r = consumption.join(known, "territory_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_territory").when(~F.col("category").isin(*CATEGORIES) | F.col("category").isNull(), "unknown_category").when(F.col("value").isNull(), "no_value")
    return r.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def panel_from_blocks(raw: DataFrame, block_territory: DataFrame, month: Column) -> DataFrame:
    """Panel of an export whose blocks were matched to territories."""
    rows = raw.join(block_territory, "block_id").select("territory_id", F.col("category_15").alias("category"), month.alias("ds"), F.col("value").alias("y")).where("ds is not null and y is not null")
    one = rows.groupBy("territory_id", "category", "ds").agg(F.max("y").alias("y"))
    return one.select(F.concat_ws("__", F.col("territory_id").cast("string"), "category").alias("unique_id"), "territory_id", "category", "ds", "y")


def series_flags(panel: DataFrame) -> DataFrame:
    """Per series: observations, first and last month, completeness against the panel, inner gaps."""
    stats = panel.groupBy("unique_id").agg(F.count("*").alias("n_obs"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    months = stats.agg(F.min("first_ds").alias("a"), F.max("last_ds").alias("b")).select((month_index(F.col("b")) - month_index(F.col("a")) + 1).alias("months"))
    span = month_index(F.col("last_ds")) - month_index(F.col("first_ds")) + 1
    return stats.crossJoin(F.broadcast(months)).select("unique_id", "n_obs", "first_ds", "last_ds", (F.col("n_obs") == F.col("months")).alias("is_complete"), (F.col("n_obs") < span).alias("has_gaps"))


def with_admin_breaks(flags: DataFrame, breaks: DataFrame) -> DataFrame:
    """Series flags with the latest administrative break of the series, NULL without one; ``breaks(unique_id, admin_break_at)``."""
    last = breaks.groupBy("unique_id").agg(F.max("admin_break_at").alias("admin_break_at"))
    return flags.join(last, "unique_id", "left")


def contract_violations(panel: DataFrame) -> DataFrame:
    """One row per rule with the number of rows that break it; two aggregates, no collect."""
    y = F.col("y")
    per_row = panel.agg(
        F.count_if(F.col("unique_id").isNull() | F.col("ds").isNull() | y.isNull()).alias("nulls"), F.count_if(y < 0).alias("negative"),
        F.count_if(F.isnan(y) | (F.abs(y) == float("inf"))).alias("not_finite"), F.count_if(F.dayofmonth("ds") != 1).alias("not_month_start"),
    )
    repeated = panel.groupBy("unique_id", "ds").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys"))
    return per_row.crossJoin(repeated).unpivot([], ["nulls", "negative", "not_finite", "not_month_start", "duplicate_keys"], "rule", "n")


def validate_panel(panel: DataFrame) -> DataFrame:
    """Return the panel, or raise ContractError naming the broken rules."""
    broken: Mapping[str, int] = {r.rule: r.n for r in contract_violations(panel).collect() if r.n}
    if broken:
        raise ContractError(f"panel contract: {broken}")
    return panel


def quantile_group(order: Column, count: Column, groups: int = 5) -> Column:
    """Equal-count group 1..n of the ``order``-th of ``count`` ranked values (linear-quantile edges)."""
    return F.when(count == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((order - 1) * groups / (count - 1)))).cast("int")


def size_groups(panel: DataFrame, level_until: str, groups: int = 5) -> DataFrame:
    """Territory size: log of the median total up to ``level_until`` and its quantile group.

    The rank runs over territories (one row each), never over the panel.
    """
    level = panel.where((F.col("category") == TOTAL) & (F.col("ds") <= F.lit(level_until).cast("date"))).groupBy("territory_id").agg(F.median("y").alias("level"))
    n = level.agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.orderBy("level", "territory_id"))
    return level.withColumn("order", order).crossJoin(F.broadcast(n)).select("territory_id", F.ln("level").alias("size_level"), quantile_group(F.col("order"), F.col("n"), groups).alias("size_group"))


def static_table(panel: DataFrame, territories: DataFrame, level_until: str) -> DataFrame:
    """One row per series: flags, territory attributes, size known at the earliest cutoff."""
    ids = panel.select("unique_id", "territory_id", "category").distinct()
    return ids.join(series_flags(panel), "unique_id").join(territories, "territory_id", "left").join(size_groups(panel, level_until), "territory_id", "left")


def additivity(panel: DataFrame) -> DataFrame:
    """Sum of the parts against the total, over (territory, month) rows that have all of them."""
    parts = [c for c in CATEGORIES if c != TOTAL]
    wide = panel.groupBy("territory_id", "ds").pivot("category", list(CATEGORIES)).agg(F.max("y"))
    return _additivity(wide, parts)


def _additivity(wide: DataFrame, parts: list[str]) -> DataFrame:
    full = wide.dropna(subset=[*parts, TOTAL]).withColumn("ratio", sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / F.nullif(F.col(TOTAL), F.lit(0.0)))
    each = F.lit(True)
    for p in parts:
        each = each & (F.col(p) <= F.col(TOTAL))
    return full.agg(
        F.count("*").alias("n"), F.median("ratio").alias("ratio_median"), F.percentile("ratio", 0.05).alias("ratio_p05"), F.percentile("ratio", 0.95).alias("ratio_p95"),
        F.avg((F.col("ratio") > 1).cast("int")).alias("share_sum_exceeds_total"), F.avg(each.cast("int")).alias("share_each_part_le_total"),
    )


def partial_additivity(panel: DataFrame, parts: list[str]) -> DataFrame:
    """The same for a chosen set of parts."""
    wide = panel.groupBy("territory_id", "ds").pivot("category", [TOTAL, *parts]).agg(F.max("y"))
    return _additivity(wide, parts)
