"""Rolling-origin folds, splits, reference forecasts and the out-of-fold table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import month_index, step_of


@dataclass(frozen=True)
class Fold:
    """One backtest window: everything up to ``cutoff`` trains, the next ``horizon`` months test."""

    name: str
    cutoff: str
    horizon: int


def make_folds(origins_by_horizon: dict[int, Sequence[str]]) -> list[Fold]:
    """A fold per (horizon, origin); names carry both, since horizons share origins."""
    folds = [Fold(f"h{h}_{o[:7]}", o, h) for h, origins in origins_by_horizon.items() for o in origins]
    if len({f.name for f in folds}) != len(folds):
        raise ValueError("fold names repeat")
    return sorted(folds, key=lambda f: (f.horizon, f.cutoff))


def folds_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    rows = spark.createDataFrame([(f.name, f.cutoff, f.horizon) for f in folds], "fold string, cutoff string, horizon int")
    return rows.withColumn("cutoff", F.to_date("cutoff"))


def eligible(panel: DataFrame, folds: DataFrame, min_train_obs: int) -> DataFrame:
    """(fold, series) with enough training rows: folds meet one row per series, not one per observation."""
    months = panel.groupBy("unique_id").agg(F.sort_array(F.collect_list("ds")).alias("d"))
    n = months.crossJoin(F.broadcast(folds)).withColumn("d", F.filter("d", lambda x: x <= F.col("cutoff")))  # a few dozen configured windows
    return n.where(F.size("d") >= max(1, min_train_obs)).select("fold", "unique_id", F.size("d").cast("long").alias("n_train"), F.element_at("d", -1).alias("last_train"))


def split_train(panel: DataFrame, folds: DataFrame, min_train_obs: int = 1) -> DataFrame:
    f = F.broadcast(folds)
    return panel.join(f, panel["ds"] <= f["cutoff"]).join(eligible(panel, folds, min_train_obs).select("fold", "unique_id"), ["fold", "unique_id"], "left_semi")


def split_test(panel: DataFrame, folds: DataFrame, min_train_obs: int = 1) -> DataFrame:
    f = F.broadcast(folds)
    rows = panel.join(f, (panel["ds"] > f["cutoff"]) & (panel["ds"] <= F.add_months(f["cutoff"], f["horizon"])))
    return rows.join(eligible(panel, folds, min_train_obs).select("fold", "unique_id"), ["fold", "unique_id"], "left_semi")


def active_series(panel: DataFrame, folds: DataFrame, min_train_obs: int = 1) -> DataFrame:
    """Series still observed in the cutoff month."""
    return eligible(panel, folds, min_train_obs).join(F.broadcast(folds), "fold").where("last_train = cutoff").select("fold", "unique_id")


def regular_series(panel: DataFrame) -> DataFrame:
    """Series without a gap between their first and last month."""
    span = month_index(F.max("ds")) - month_index(F.min("ds")) + 1
    return panel.groupBy("unique_id").agg(F.count("*").alias("n"), span.alias("span")).where("n = span").select("unique_id", "n")


def coverage_problems(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Folds whose test window runs past the data."""
    last = panel.agg(F.max("ds").alias("last_ds"))
    return F.broadcast(folds).crossJoin(last).withColumn("test_end", F.add_months("cutoff", F.col("horizon"))).where("test_end > last_ds").select("fold", "test_end", "last_ds")


def validate_forecast(forecast: DataFrame, test: DataFrame) -> DataFrame:
    """Counts of contract violations of a forecast against its test window."""
    own = forecast.agg(F.count_if(F.col("y_hat").isNull() | F.isnan("y_hat")).alias("no_value"), F.count_if(F.col("y_hat") < 0).alias("negative"))
    repeated = forecast.groupBy("fold", "unique_id", "ds", "model").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    stray = forecast.join(test.select("fold", "unique_id", "ds").distinct(), ["fold", "unique_id", "ds"], "left_anti").agg(F.count("*").alias("outside_test"))
    return own.crossJoin(repeated).crossJoin(stray)


def build_oof(test: DataFrame, forecast: DataFrame) -> DataFrame:
    """Predictions joined to actuals, with cutoff, horizon and step."""
    t = test.select("fold", "unique_id", "ds", "category", "cutoff", "horizon", "y")
    return t.join(forecast, ["fold", "unique_id", "ds"]).withColumn("step", step_of(F.col("ds"), F.col("cutoff")))


def reference_forecasts(panel: DataFrame, folds: DataFrame, min_train_obs: int = 6) -> DataFrame:
    """Naive (last value), seasonal naive (same month a year before, else naive) and drift.

    Each is an aggregate of the training rows and one equi-join on the month twelve before.
    """
    train = split_train(panel, folds, min_train_obs)
    last = train.groupBy("fold", "unique_id", "cutoff", "horizon").agg(F.max_by("y", "ds").alias("last"), F.min_by("y", "ds").alias("first"), (month_index(F.max("ds")) - month_index(F.min("ds"))).alias("span"), month_index(F.max("ds")).alias("last_mi"))
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon")))).withColumn("ds", F.add_months("cutoff", F.col("step")))
    year_ago = panel.select("unique_id", F.add_months("ds", 12).alias("ds"), F.col("y").alias("ago"), F.col("ds").alias("ago_ds"))
    rows = rows.join(year_ago, ["unique_id", "ds"], "left")
    slope = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("span")), F.lit(0.0))
    drift = F.greatest(F.lit(0.0), F.col("last") + slope * (month_index(F.col("ds")) - F.col("last_mi")))
    seasonal = F.when(F.col("ago_ds") <= F.col("cutoff"), F.col("ago"))
    wide = rows.select("fold", "unique_id", "ds", F.col("last").alias("naive"), F.coalesce(seasonal, F.col("last")).alias("seasonal_naive"), drift.alias("drift"))
    return wide.unpivot(["fold", "unique_id", "ds"], ["naive", "seasonal_naive", "drift"], "model", "y_hat")


def training_origins(panel: DataFrame, cutoff: str, horizon: int, min_history: int) -> DataFrame:
    """Origins a direct model may learn from: late enough for history, early enough for targets."""
    months = panel.where(F.col("ds") <= F.lit(cutoff).cast("date")).select("ds").distinct()
    rank = F.row_number().over(Window.orderBy("ds"))  # one row per month of the panel
    return months.withColumn("n", rank).where((F.col("n") >= min_history) & (F.add_months("ds", horizon) <= F.lit(cutoff).cast("date"))).select(F.col("ds").alias("origin"))


def common_rows(oof: DataFrame) -> DataFrame:
    """Rows of observations that every model of the horizon predicted (relational division)."""
    total = oof.groupBy("horizon").agg(F.countDistinct("model").alias("models"))
    keys = oof.groupBy("horizon", "unique_id", "ds", "fold").agg(F.countDistinct("model").alias("n")).join(F.broadcast(total), "horizon").where("n = models")
    return oof.join(keys.select("horizon", "unique_id", "ds", "fold"), ["horizon", "unique_id", "ds", "fold"], "left_semi")


def common_to(oof: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows of ``models`` on the observations that all of them predicted."""
    part = oof.where(F.col("model").isin(*models))
    keys = part.groupBy("unique_id", "ds", "fold").agg(F.countDistinct("model").alias("n")).where(F.col("n") == len(set(models)))
    return part.join(keys, ["unique_id", "ds", "fold"], "left_semi")


def freshest_forecast(oof: DataFrame, max_horizon: int | None = None) -> DataFrame:
    """One forecast per series, month and model: shortest horizon, then latest cutoff."""
    o = oof if max_horizon is None else oof.where(F.col("horizon") <= max_horizon)
    best = F.row_number().over(Window.partitionBy("unique_id", "ds", "model").orderBy("horizon", F.col("cutoff").desc(), "fold"))
    return o.withColumn("rn", best).where("rn = 1").drop("rn")


def stratified_counts(series: DataFrame, stratum: str, n: int) -> DataFrame:
    """Series to draw from each stratum, in proportion, rounded half to even."""
    by = series.groupBy(stratum).agg(F.countDistinct("unique_id").alias("size"))
    total = by.agg(F.sum("size").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(stratum, "size", F.bround(F.col("size") / F.col("total") * n, 0).cast("long").alias("take"))


def stratified_sample(series: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """A reproducible draw: the first of each stratum by a seeded hash of the id."""
    ids = series.select("unique_id", stratum).distinct()
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), "unique_id"), "unique_id")
    return ids.withColumn("rn", F.row_number().over(order)).join(stratified_counts(series, stratum, n), stratum).where("rn <= take").select("unique_id", stratum)
