"""National indicators as monthly features, each known only after its source's own publication lag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import published_on
from kronopanel.operators.entities import column_key
from kronopanel.operators.features import as_of_origin

#: Days after the end of its month by which a source is published.
DEFAULT_LAG, WEEKLY_LAG = 35, 7


@dataclass(frozen=True)
class Indicator:
    """How a source becomes features: its ``level``, its ``growth`` (month and year), or level and ``change``."""

    slug: str
    prefix: str
    dims: tuple[str, ...] = ()
    mode: str = "level"
    lag: int = DEFAULT_LAG

    def __post_init__(self) -> None:
        if self.mode not in ("level", "growth", "change"):
            raise ValueError(f"{self.slug}: mode {self.mode!r}")


def indicator_values(readings: DataFrame, sources: Sequence[Indicator]) -> DataFrame:
    """``source, lag, feature, ds, value`` in long form: monthly means, growth or change of each indicator.

    ``readings(slug, ds, value, <dims>)``.  Growth compares rows of the source: every month in which the source
    has any reading is a row of each of its features, the last known value filling in; the division by zero is NULL.
    Defined edge cases: a NULL dimension is part of the name as 'none'; readings without month or value, and
    sources that no indicator names, are left out.
    """
    spark = readings.sparkSession
    r = readings.where("ds is not null and value is not null and not isnan(value)").withColumn("ds", F.trunc("ds", "MM"))
    if not sources:
        return spark.createDataFrame([], "source string, lag int, feature string, ds date, value double")

    def feature(s: Indicator) -> Column:
        key = F.concat_ws("|", *[F.coalesce(F.col(d), F.lit("none")) for d in s.dims]) if s.dims else F.lit("")
        return F.when(key == "", F.lit(s.prefix)).otherwise(F.concat(F.lit(s.prefix + "_"), column_key(key)))

    own = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col("slug") == s.slug, feature(s)).alias("feature")) for i, s in enumerate(sources)])
    named = r.select(F.explode(F.filter(own, lambda x: x["feature"].isNotNull())).alias("x"), "ds", "value").select("x.*", "ds", "value")  # one scan for all sources
    monthly = named.groupBy("i", "feature", "ds").agg(F.avg("value").alias("value"))
    modes = F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (i, s.mode)])
    monthly = monthly.withColumn("mode", modes[F.col("i")])
    level = monthly.where("mode <> 'growth'").select("i", "feature", "ds", "value")
    months = monthly.where("mode <> 'level'").select("i", "ds").distinct()
    grid = monthly.where("mode <> 'level'").select("i", "feature", "mode").distinct().join(months, "i").join(monthly.select("i", "feature", "ds", "value"), ["i", "feature", "ds"], "left")
    by = Window.partitionBy("i", "feature").orderBy("ds")
    grid = grid.withColumn("f", F.last("value", ignorenulls=True).over(by))
    rel = lambda k: F.try_divide(F.col("f"), F.lag("f", k).over(by)) - 1
    grid = grid.select("i", "feature", "ds", "mode", rel(1).alias("mom"), rel(12).alias("yoy"), (F.col("value") - F.lag("value").over(by)).alias("accel"))
    derived = [grid.where(f"mode = '{mode}'").select("i", F.concat("feature", F.lit(f"_{c}")).alias("feature"), "ds", F.col(c).alias("value")) for mode, c in (("growth", "mom"), ("growth", "yoy"), ("change", "accel"))]
    out = level
    for d in derived:
        out = out.unionByName(d)
    info = spark.createDataFrame([(i, s.slug, s.lag) for i, s in enumerate(sources)], "i int, source string, lag int")
    return out.where("value is not null").join(F.broadcast(info), "i").select("source", "lag", "feature", "ds", "value")  # a row per source


def national_groups(values: DataFrame) -> dict[int, DataFrame]:
    """Per publication lag one wide monthly table with the day it is known: groups of other lags must not mix.

    The features of a lag are a catalogue, not data: their names are collected to be columns.
    """
    names = values.select("lag", "feature").distinct().orderBy("lag", "feature").collect()
    out = {}
    for lag in sorted({r.lag for r in names}):
        own = [r.feature for r in names if r.lag == lag]
        wide = values.where(F.col("lag") == lag).groupBy("ds").pivot("feature", own).agg(F.avg("value"))
        out[lag] = wide.withColumn("published_on", published_on(F.col("ds"), lag))
    return out


def national_as_of(groups: Mapping[int, DataFrame], origins: DataFrame) -> DataFrame:
    """Each origin with the latest published month of every group; the lag stands in the columns' names."""
    out = origins.select("origin").distinct()
    for lag, wide in sorted(groups.items()):
        known = as_of_origin(wide.drop("published_on"), origins.select("origin").distinct(), lag).drop("ds")
        out = out.join(known.select("origin", *[F.col(f"`{c}`").alias(f"nat{lag}__{c}") for c in known.columns if c != "origin"]), "origin", "left")
    return out


#: Event classes whose shares are features.
EVENT_GROUPS = {"protest": ("14",), "violence": ("18", "19", "20"), "coerce": ("17",), "cooperate": ("05", "06", "07"), "statements": ("01", "02", "03", "04")}


def coded_event_features(events: DataFrame, *, level: str = "region", cutoff: str | None = None) -> DataFrame:
    """Region-months (or country-months) of coded events: number, articles, tone, conflict, shares of classes.

    ``events(date_added, region_code, event_root_code, num_articles, avg_tone, goldstein, quad_class)``; an event counts in
    the month it was added, and not at all if it was added after ``cutoff``.  Events without region are part of the country only.
    """
    if level not in ("region", "country"):
        raise ValueError(f"level {level!r}")
    e = events.where("date_added is not null")
    if cutoff is not None:
        e = e.where(F.col("date_added") <= F.lit(cutoff).cast("date"))
    keys = ["ds"] if level == "country" else ["region_code", "ds"]
    e = e.withColumn("ds", F.trunc("date_added", "MM")).withColumn("root", F.lpad(F.col("event_root_code").cast("string"), 2, "0"))
    if level == "region":
        e = e.where("region_code is not null")
    prefix = "country_news_" if level == "country" else "news_"
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    return e.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}events"), F.sum("num_articles").alias(f"{prefix}articles"), F.avg("avg_tone").alias(f"{prefix}tone_mean"), F.min("avg_tone").alias(f"{prefix}tone_min"),
        F.avg("goldstein").alias(f"{prefix}goldstein_mean"), share(F.col("quad_class") == 4).alias(f"{prefix}material_conflict_share"),
        *[share(F.col("root").isin(*v)).alias(f"{prefix}share_{k}") for k, v in EVENT_GROUPS.items()],
    )


def covariates(rows: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Known-future covariates of (series, month) rows: month angles and the seasonal index of the category, 1 where there is none."""
    s = F.broadcast(seasonal.select("category", "month", F.col("index").alias("seasonal_index")))  # categories x 12
    angle = 2 * 3.141592653589793 * F.month("ds") / 12
    out = rows.withColumn("month", F.month("ds")).join(s, ["category", "month"], "left").drop("month")
    return out.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle)).withColumn("seasonal_index", F.coalesce("seasonal_index", F.lit(1.0)))


def future_rows(panel: DataFrame, cutoff: str, horizon: int) -> DataFrame:
    """The months to forecast of every series that has a row up to the cutoff."""
    known = panel.where(F.col("ds") <= F.lit(cutoff).cast("date")).groupBy("unique_id").agg(F.min("category").alias("category"))
    months = F.sequence(F.add_months(F.lit(cutoff).cast("date"), 1), F.add_months(F.lit(cutoff).cast("date"), horizon), F.expr("interval 1 month"))
    return known.withColumn("ds", F.explode(months))


# -- columns by rule ---------------------------------------------------------------------------------


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Columns a direct model may learn from: neither keys, nor the target and what it is made of."""
    return [c for c in columns if c not in {"unique_id", "origin", "ds", "y", "target", "y_last"}]


def hazard_feature_columns(columns: Sequence[str]) -> list[str]:
    """Columns a break model may learn from: neither keys nor any label."""
    return [c for c in columns if c not in {"unique_id", "region_code", "t", "ds"} and not c.startswith("z_h")]


def is_prediction_column(name: str) -> bool:
    """Whether a column belongs to one model's forecast rather than to the observation."""
    return name in ("model", "y_hat") or name.startswith("q_")


def feature_sets(blocks: Mapping[str, Sequence[str]], variants: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Feature lists of named variants, each a list of blocks; an unknown block is an error."""
    out = {}
    for name, parts in variants.items():
        if unknown := [p for p in parts if p not in blocks]:
            raise KeyError(f"{name}: no block {unknown}")
        out[name] = [c for p in parts for c in blocks[p]]
    return out
