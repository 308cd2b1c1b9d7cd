"""Point-in-time features: lags, national series, news, calendar events, graph, weather, calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import latest_published_month, month_index, month_start

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)


# -- own history -----------------------------------------------------------------------------------


def lag_features(panel: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Ratios of past values and rolling statistics to the current value, by calendar month.

    RANGE frames over the month index are exact on series with gaps: a missing month gives NULL.
    All windows share one partitioning and ordering, hence one shuffle and one sort.
    """
    by = Window.partitionBy("unique_id").orderBy("mi")
    p = panel.withColumn("mi", month_index(F.col("ds"))).where("y is not null")
    cols = [F.max("y").over(by.rangeBetween(-k, -k)).alias(f"raw_{k}") for k in lags]
    cols += [F.avg("y").over(by.rangeBetween(1 - w, 0)).alias(f"mean_{w}") for w in windows]
    cols += [F.stddev_pop("y").over(by.rangeBetween(1 - w, 0)).alias(f"std_{w}") for w in windows]
    cols += [F.count("y").over(by.rangeBetween(Window.unboundedPreceding, 0)).alias("n_history")]
    out = p.select("*", *cols).where("y > 0")
    y = F.col("y")
    return out.select(
        "unique_id", F.col("ds").alias("origin"), y.alias("y_last"), *[(F.col(f"raw_{k}") / y).alias(f"lag_{k}") for k in lags],
        *[(F.col(f"mean_{w}") / y).alias(f"roll_mean_{w}") for w in windows], *[(F.col(f"std_{w}") / y).alias(f"roll_std_{w}") for w in windows], "n_history",
    )


def direct_rows(panel: DataFrame, horizon: int, *, seasonal: DataFrame | None = None, min_history: int = 7) -> DataFrame:
    """Training rows (series, origin, step) of a direct multi-step model with their log-ratio target."""
    feats = lag_features(panel).where(F.col("n_history") >= min_history)
    rows = feats.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.add_months("origin", F.col("step")))
    target = panel.select("unique_id", "ds", "y", "category").where("y >= 0")
    rows = rows.join(target, ["unique_id", "ds"]).withColumn("target", F.ln((F.col("y") + 1) / (F.col("y_last") + 1)))
    if seasonal is not None:
        s = seasonal.select("category", F.col("month").alias("m"), F.col("index").alias("s"))
        rows = rows.withColumn("m_t", F.month("ds")).withColumn("m_o", F.month("origin"))
        at = lambda name: F.broadcast(s.select("category", F.col("m").alias(f"m_{name}"), F.col("s").alias(f"s_{name}")))  # noqa: E731 - categories x 12 rows
        rows = rows.join(at("t"), ["category", "m_t"], "left").join(at("o"), ["category", "m_o"], "left")
        rows = rows.withColumn("seasonal_ratio", F.coalesce("s_t", F.lit(1.0)) / F.coalesce("s_o", F.lit(1.0))).drop("m_t", "m_o", "s_t", "s_o")
    return rows


def forecast_from_ratio(y_last: Column, log_ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), (y_last + 1) * F.exp(log_ratio) - 1)


# -- seasonality -----------------------------------------------------------------------------------


def ratio_to_moving_average(series: DataFrame, key: str = "unique_id") -> DataFrame:
    """Value over its centred 2x12 moving average; NULL where the window is not full."""
    by = Window.partitionBy(key).orderBy("ds")
    half = by.rowsBetween(-6, 5)
    ma = F.when((F.count("y").over(half) == 12) & (F.count(F.lit(1)).over(half) == 12), F.avg("y").over(half))
    return series.withColumn("ma12", ma).withColumn("ma", (F.col("ma12") + F.lead("ma12").over(by)) / 2).withColumn("ratio", F.try_divide("y", "ma")).drop("ma12")


def seasonal_index(ratios: DataFrame, key: str) -> DataFrame:
    """Median ratio by month, normalised to mean 1 over the months of the key."""
    by_month = ratios.where("ratio is not null").groupBy(key, F.month("ds").alias("month")).agg(F.median("ratio").alias("raw"))
    return by_month.select(key, "month", (F.col("raw") / F.avg("raw").over(Window.partitionBy(key))).alias("index"))


def seasonal_index_as_of(series: DataFrame, key: str, origin: str, lag_days: int) -> DataFrame:
    """Seasonal index from what was published by the end of the origin month."""
    last = latest_published_month(F.lit(origin).cast("date"), lag_days)
    return seasonal_index(ratio_to_moving_average(series.where(F.col("ds") <= last), key), key)


def panel_seasonal_index(panel: DataFrame) -> DataFrame:
    """Median profile of value over series-year mean, full years only, by category and month."""
    year = Window.partitionBy("unique_id", F.year("ds"))
    p = panel.select("*", F.count("y").over(year).alias("n"), F.avg("y").over(year).alias("mean")).where("n = 12")
    prof = p.groupBy("category", F.month("ds").alias("month")).agg(F.median(F.try_divide("y", "mean")).alias("raw"))
    return prof.select("category", "month", (F.col("raw") / F.avg("raw").over(Window.partitionBy("category"))).alias("index"))


def seasonal_amplitude(index: DataFrame) -> DataFrame:
    return index.groupBy("category").agg((F.max("index") / F.min("index")).alias("amplitude"))


# -- publication-lag joins -------------------------------------------------------------------------


def as_of_origin(monthly: DataFrame, origins: DataFrame, lag_days: int) -> DataFrame:
    """Each origin with the latest month published by its end: an equi-join on a closed form."""
    o = origins.select("origin").withColumn("ds", latest_published_month(F.col("origin"), lag_days))
    return o.join(monthly, "ds", "left")


def as_of_many_lags(monthly: DataFrame, origins: DataFrame, lags: Mapping[str, int]) -> DataFrame:
    """One prefixed column group per source lag; ``lags`` maps a value column to its lag in days."""
    out = origins.select("origin")
    for lag in sorted(set(lags.values())):
        cols = [c for c, v in lags.items() if v == lag]
        part = as_of_origin(monthly.select("ds", *cols), origins, lag).select("origin", *[F.col(c).alias(f"nat{lag}__{c}") for c in cols])
        out = out.join(part, "origin", "left")
    return out


def monthly_values(series: DataFrame, dims: Sequence[str], how: str = "mean") -> DataFrame:
    agg = {"mean": F.avg, "sum": F.sum, "last": lambda c: F.max_by(c, "ds")}[how]
    return series.groupBy(*dims, month_start(F.col("ds")).alias("month")).agg(agg("value").alias("value"))


def pivot_indicator(monthly: DataFrame, dim: str, values: Sequence[str], prefix: str) -> DataFrame:
    """One column per listed dimension value; listing them keeps the plan a single aggregate."""
    wide = monthly.groupBy("month").pivot(dim, list(values)).agg(F.avg("value"))
    return wide.select("month", *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def growth(series: DataFrame, key: str = "unique_id") -> DataFrame:
    """Row-based change over 1 and 12 rows of the forward-filled value, and its difference."""
    by = Window.partitionBy(key).orderBy("ds")
    f = series.withColumn("f", F.last("y", ignorenulls=True).over(by))
    f = f.select(key, "ds", (F.try_divide(F.col("f"), F.lag("f", 1).over(by)) - 1).alias("mom"), (F.try_divide(F.col("f"), F.lag("f", 12).over(by)) - 1).alias("yoy"))
    return f.withColumn("mom_change", F.col("mom") - F.lag("mom").over(by))


def novelty(series: DataFrame, value: str, key: str, window: int = 6) -> DataFrame:
    """z of a value against the previous rows; a flat history is scaled by a tenth of its mean."""
    before = Window.partitionBy(key).orderBy("ds").rowsBetween(-window, -1)
    n, mean, sd = F.count(value).over(before), F.avg(value).over(before), F.stddev_samp(value).over(before)
    scale = F.when(sd > 0, sd).otherwise(F.greatest(F.abs(mean) * 0.1, F.lit(1e-9)))
    return series.withColumn(f"{value}_z", F.when(n >= 2, (F.col(value) - mean) / scale))


# -- exogenous blocks ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """A feature table with its time kind: known_future (by ds), past_only (by origin), static."""

    name: str
    frame: DataFrame
    kind: str
    entities: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("known_future", "past_only", "static"):
            raise ValueError(f"{self.name}: kind {self.kind!r}")
        missing = [c for c in self.keys if c not in self.frame.columns]
        if missing or not self.keys:
            raise ValueError(f"{self.name}: no key columns {missing}")

    @property
    def keys(self) -> list[str]:
        time = {"known_future": ["ds"], "past_only": ["origin"], "static": []}[self.kind]
        return [*self.entities, *time]

    def check_unique(self) -> None:
        if self.frame.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"{self.name}: repeated keys {self.keys}")


def join_blocks(rows: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """Left-join blocks by the keys of their kind; clashing columns are an error, not a suffix."""
    for b in blocks:
        clash = (set(b.frame.columns) - set(b.keys)) & set(rows.columns)
        if clash:
            raise ValueError(f"{b.name}: columns {sorted(clash)} exist already")
        rows = rows.join(b.frame, b.keys, "left")
    return rows


# -- news and curated events -----------------------------------------------------------------------


def event_counts(events: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]], *, cutoff: Column | None = None) -> DataFrame:
    """Size, value statistics and conditional shares per key; later-added events are left out.

    ``events(kind, class, value, added)``; conflict share is that of class 4.
    """
    e = events if cutoff is None else events.where(F.col("added") <= cutoff)
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    return e.groupBy(*keys).agg(
        F.count("*").alias("news_events"), F.sum("value").alias("news_value"), F.avg("value").alias("news_mean"), F.min("value").alias("news_min"),
        share(F.col("class") == 4).alias("news_conflict_share"), *[share(F.col("kind").isin(*v)).alias(f"news_share_{k}") for k, v in groups.items()],
    )


def unmapped_share(events: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Share of coded events whose code has no region."""
    m = mapping.select(code).distinct().withColumn("mapped", F.lit(1))
    return events.where(F.col(code).isNotNull()).join(m, code, "left").agg(F.count("*").alias("n"), F.count_if(F.col("mapped").isNull()).alias("unmapped")).withColumn("share", F.try_divide("unmapped", "n"))


def events_as_of(events: DataFrame, grid: DataFrame, decay: float = 0.5) -> DataFrame:
    """Per (region, origin, kind): whether an event happened that month, and the decayed trace of all.

    Counts only what was published by the end of the origin month.  Instead of a range join of grid
    and events, each event is expanded along its own tail of origins (a bounded time axis), then
    grouped; national events are applied to every region of the grid in the final equi-join.
    """
    e = events.select(F.coalesce(F.when(F.col("region_code") == "", None).otherwise(F.col("region_code")), F.lit("all")).alias("scope"), "kind", month_start(F.coalesce("date", "published_at")).alias("start"), F.greatest(month_start(F.coalesce("date", "published_at")), month_start(F.coalesce("published_at", "date"))).alias("seen")).where("start is not null and kind is not null")
    per = e.groupBy("scope", "kind", "start", "seen").agg(F.count("*").alias("n"))
    origins = grid.select("origin").distinct()
    last = origins.agg(F.max("origin").alias("last"))
    trail = per.crossJoin(F.broadcast(last)).where("seen <= last").withColumn("origin", F.explode(F.sequence("seen", "last", F.expr("interval 1 month"))))
    gap = month_index(F.col("origin")) - month_index(F.col("start"))
    known = trail.groupBy("scope", "kind", "origin").agg(F.max((gap == 0).cast("int")).alias("flag"), F.max(F.pow(F.lit(decay), gap)).alias("trace"))
    own = grid.join(known.withColumnRenamed("scope", "region_code"), ["region_code", "origin"])
    everywhere = grid.join(known.where("scope = 'all'").drop("scope"), "origin").select("region_code", "origin", "kind", "flag", "trace")
    both = own.select("region_code", "origin", "kind", "flag", "trace").unionByName(everywhere)
    return both.groupBy("region_code", "origin", "kind").agg(F.max("flag").alias("flag"), F.max("trace").alias("trace"))


# -- graph -----------------------------------------------------------------------------------------


def nearest_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest neighbours in an undirected graph; loops dropped, the shortest edge kept."""
    both = edges.select("x", "y", "distance").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")).where("x <> y")
    near = both.groupBy("x", "y").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("distance", "y"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_features(panel: DataFrame, pairs: DataFrame, lags: Sequence[int] = (1, 3)) -> DataFrame:
    """Mean log growth of the neighbours' same category, and the series' level gap to them."""
    by = Window.partitionBy("territory_id", "category").orderBy("mi")
    p = panel.where("y > 0").select("territory_id", "category", "ds", F.ln("y").alias("l"), month_index(F.col("ds")).alias("mi"))
    p = p.select("*", *[(F.col("l") - F.max("l").over(by.rangeBetween(-k, -k))).alias(f"g{k}") for k in lags])
    theirs = p.select(F.col("territory_id").alias("y"), "category", "ds", F.col("l").alias("nl"), *[F.col(f"g{k}") for k in lags])
    agg = pairs.select("x", "y").join(theirs, "y").groupBy(F.col("x").alias("territory_id"), "category", "ds").agg(F.avg("nl").alias("nl"), *[F.avg(f"g{k}").alias(f"neighbour_growth_{k}") for k in lags])
    return p.select("territory_id", "category", "ds", "l").join(agg, ["territory_id", "category", "ds"]).select("territory_id", "category", "ds", *[f"neighbour_growth_{k}" for k in lags], (F.col("l") - F.col("nl")).alias("neighbour_gap"))


def access_features(territories: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    near = pairs.groupBy(F.col("x").alias("territory_id")).agg(F.log1p(F.avg("distance")).alias("log_distance"))
    return territories.select("territory_id").distinct().join(index, "territory_id", "left").join(near, "territory_id", "left").select("territory_id", F.when(F.col("access") > 0, F.ln("access")).alias("log_access"), "log_distance")


# -- gridded weather -------------------------------------------------------------------------------

LAT_STEP, LON_STEP = 0.5, 0.625


def grid_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Nearest grid node; longitude wraps at 180 degrees."""
    i = F.floor(lat / LAT_STEP + 0.5)
    j = F.pmod(F.floor((lon + 180) / LON_STEP + 0.5), F.lit(576))
    return i * LAT_STEP, j * LON_STEP - 180


def with_norms(weather: DataFrame, value: str, first_year: int, last_year: int) -> DataFrame:
    """Anomaly against the cell's mean of the same calendar month in the norm years."""
    norm = weather.where(F.year("ds").between(first_year, last_year)).groupBy("cell", F.month("ds").alias("moy")).agg(F.avg(value).alias("norm"))
    out = weather.withColumn("moy", F.month("ds")).join(norm, ["cell", "moy"], "left")
    return out.withColumn("anomaly", F.col(value) - F.col("norm"))


def rolling_mean(frame: DataFrame, value: str, key: str, rows: int = 3) -> DataFrame:
    """Mean of the last rows of a cell; it never reaches into another cell."""
    return frame.withColumn(f"{value}_{rows}", F.avg(value).over(Window.partitionBy(key).orderBy("ds").rowsBetween(1 - rows, 0)))


def climate_norms(weather: DataFrame, value: str, months: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Norm of every cell for every month asked: cells x months, both bounded by grid and time axis."""
    norm = weather.where(F.year("ds").between(first_year, last_year)).groupBy("cell", F.month("ds").alias("moy")).agg(F.avg(value).alias("norm"))
    return months.withColumn("moy", F.month("ds")).join(norm, "moy").select("cell", "ds", "norm")


# -- calendar --------------------------------------------------------------------------------------


def calendar_features(months: DataFrame, working_days: DataFrame | None = None) -> DataFrame:
    m = F.month("ds")
    angle = 2 * 3.141592653589793 * m / 12
    out = months.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle)).withColumn("days_in_month", F.dayofmonth(F.last_day("ds")))
    out = out.withColumn("is_sales_month", m.isin(3, 11).cast("int")).withColumn("is_december", (m == 12).cast("int")).withColumn("is_january", (m == 1).cast("int"))
    if working_days is not None:
        out = out.join(working_days, "ds", "left").withColumn("working_day_share", F.col("working_days") / F.col("days_in_month"))
    return out


def month_spine(spark, first: str, last: str) -> DataFrame:  # noqa: ANN001
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("ds"))


def parse_day_tokens(months: DataFrame) -> DataFrame:
    """``year, month, days`` ('1,2*,3+') -> off days, short days and moved holidays of the month.

    A plain number is a day off, ``*`` marks a shortened working day, ``+`` a moved day off.
    """
    tokens = F.filter(F.transform(F.split("days", ","), F.trim), lambda t: t != "")
    off = F.filter(tokens, lambda t: ~t.endswith("*"))
    ds = F.make_date("year", "month", F.lit(1))
    return months.select(ds.alias("ds"), F.size(off).alias("days_off"), F.size(F.filter(tokens, lambda t: t.endswith("*"))).alias("short_days"), F.size(F.filter(tokens, lambda t: t.endswith("+"))).alias("moved_days"), (F.dayofmonth(F.last_day(ds)) - F.size(off)).alias("working_days"))
