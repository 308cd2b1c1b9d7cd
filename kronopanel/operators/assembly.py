"""Feature assembly, cached steps, and the tables behind reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.operators.features import Block, join_blocks
from kronopanel.sources.files import stale_inputs, write_stamp


def feature_table(rows: DataFrame, static: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """Direct rows with static attributes and exogenous blocks.

    A block keyed by territory or region borrows that key from the static table; past blocks join by
    origin on every step, known-future ones by the target month.
    """
    own = ["unique_id", *[c for c in static.columns if c != "unique_id" and c not in rows.columns]]
    return join_blocks(rows.join(static.select(*own), "unique_id", "left"), blocks)


def run_cached(path: Path, inputs: Mapping[str, str], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A step's table from disk while its inputs are unchanged, else made anew; tells which."""
    stamp = path.with_suffix(".stamp.json")
    df = None
    if stale_inputs(stamp, dict(inputs)) or not path.exists():
        df = make()
        df.write.mode("overwrite").parquet(str(path))
        write_stamp(stamp, dict(inputs))
        return df.sparkSession.read.parquet(str(path)), True
    from pyspark.sql import SparkSession

    return SparkSession.active().read.parquet(str(path)), False


def rekey(rows: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Rows under new keys; unknown keys and keys with several targets are errors."""
    unknown = rows.select(old).distinct().join(mapping.select(old), old, "left_anti").limit(1).count()
    several = mapping.groupBy(old).agg(F.countDistinct(new).alias("n")).where("n > 1").limit(1).count()
    if unknown or several:
        raise ValueError("unknown keys" if unknown else "keys with several targets")
    return rows.join(mapping.select(old, new).distinct(), old).drop(old)


def value_runs(rows: DataFrame, key: str, order: str, known: Column) -> DataFrame:
    """Maximal runs of consecutive rows for which ``known`` holds."""
    by = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("known", known.cast("int")).withColumn("island", F.sum(1 - F.col("known")).over(by)).where("known = 1")
    return r.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def largest_per_group(series: DataFrame, group: str, value: str, limit: int) -> DataFrame:
    """The largest series of each group, then the largest of those."""
    first = series.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), "unique_id"))).where("rn = 1").drop("rn")
    return first.orderBy(F.desc(value), "unique_id").limit(limit)


def top_with_baseline(rows: DataFrame, score: str, k: int, baseline: Column) -> DataFrame:
    """The k best rows of a small table, and the baseline wherever it stands."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *[c for c in rows.columns if c != score])))
    return ranked.where((F.col("rank") <= k) | baseline)


def steady_differences(per_window: DataFrame, pair: str, value: str) -> DataFrame:
    """Windows that agree with the mean's sign, and whether an exact sign test calls that steady.

    The two-sided binomial tail is a sum over at most the number of windows.
    """
    m = per_window.groupBy(pair).agg(F.avg(value).alias("mean"), F.count_if(F.col(value) < 0).alias("lower"), F.count_if(F.col(value) > 0).alias("higher"))
    n, k = F.col("lower") + F.col("higher"), F.least("lower", "higher")
    choose = lambda i: F.factorial(n.cast("int")) / (F.factorial(i) * F.factorial(n.cast("int") - i))  # noqa: E731 - at most 20 windows
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, i: a + choose(i))
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))
    return m.withColumn("agreeing", F.when(F.col("mean") < 0, F.col("lower")).otherwise(F.col("higher"))).withColumn("sign_p", p).withColumn("steady", F.col("sign_p") < 0.05)


def strongest_event(stream: DataFrame, events: DataFrame) -> DataFrame:
    """Per region the month of the strongest residual and the events known in it."""
    top = stream.groupBy("region_code").agg(F.max_by(F.struct("unique_id", "ds", "z"), F.struct(F.abs("z"), "unique_id", "ds")).alias("m")).select("region_code", "m.*")
    kinds = events.groupBy("region_code", F.trunc("date", "MM").alias("ds")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return top.join(kinds, ["region_code", "ds"], "left")


def event_hits(events: DataFrame, alarms: DataFrame, margin: int) -> DataFrame:
    """Per kind: events of the panel's span, and those with an alarm within ``margin`` months."""
    mi = lambda c: F.year(c) * 12 + F.month(c)
    months = alarms.select(mi(F.col("ds")).alias("a")).distinct()
    near = months.select(F.explode(F.sequence(F.col("a") - margin, F.col("a") + margin)).alias("m")).distinct().withColumn("hit", F.lit(1))
    e = events.withColumn("m", mi(F.col("date"))).join(F.broadcast(near), "m", "left")  # one row per month
    return e.groupBy("kind").agg(F.count("*").alias("events"), F.count("hit").alias("hits")).withColumn("share", F.col("hits") / F.col("events"))


def gated(table: DataFrame, reference: DataFrame, key: str, least: float = 0.9) -> DataFrame | None:
    """The table, if it covers enough of the reference's keys; else None."""
    r = reference.select(key).distinct().join(table.select(key).distinct().withColumn("has", F.lit(1)), key, "left").agg(F.count("*").alias("n"), F.count("has").alias("k")).first()
    return table if r.n and r.k / r.n >= least else None


def population_features(population: DataFrame, territories: DataFrame) -> DataFrame:
    """Log population and its share of the region."""
    p = territories.select("territory_id", "region_code").join(population, "territory_id", "left")
    total = F.sum("population").over(Window.partitionBy("region_code"))
    return p.select("territory_id", F.when(F.col("population") > 0, F.ln("population")).alias("log_population"), F.try_divide("population", total).alias("region_share"))
