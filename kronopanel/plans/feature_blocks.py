"""The exogenous feature blocks of the panel, each with its own rule of time, and what of them reaches the direct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators import assembly as A
from kronopanel.operators import features as X
from kronopanel.operators import national as N
from kronopanel.plans.inputs import Registry, edges, news, panel, territory
from kronopanel.plans.panel_queries import INDICATORS, _indicators, _known, _weather
from kronopanel.session import materialize, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

FIRST, LAST, LAST_FUTURE = "2023-01-01", "2024-12-01", "2025-12-01"


def load_blocks(spark: SparkSession, root: str) -> dict[str, X.Block]:
    """Nine blocks: two of the future, five of the past, two that do not change.

    ``news`` holds the columns of ``events`` and ``coded`` in one table, for models that take both or neither; its
    columns are theirs, so it is joined instead of them.  The tables have neither populations nor an index of access: the median
    total of a territory and a number derived from its id stand in.
    """
    origins = X.month_spine(spark, FIRST, LAST).withColumnRenamed("ds", "origin")
    calendar = X.calendar_features(X.month_spine(spark, FIRST, LAST_FUTURE))
    macro = N.national_as_of(N.national_groups(_indicators(spark, root)), origins)
    events = _known(spark, root).groupBy("region_code", "origin").agg(F.sum("flag").alias("events_now"), F.max("trace").alias("events_trace"))
    monthly = X.event_counts(news(spark, root).withColumn("ds", F.trunc("added", "MM")), ["ds"], {"buying": ("purchase", "refund")})
    coded = X.as_of_origin(monthly, origins, 0).drop("ds")
    t = territory(spark, root)
    both = events.join(coded, "origin", "full_outer")
    pairs = X.nearest_neighbours(edges(spark, root), 3)
    near = X.neighbour_features(panel(spark, root), pairs).withColumnRenamed("ds", "origin")
    weather = X.rolling_mean(X.with_norms(_weather(spark, root), "t", 2022, 2023), "anomaly", "cell").select(F.col("cell").alias("region_code"), "ds", F.col("anomaly").alias("weather_anomaly"), F.col("anomaly_3").alias("weather_anomaly_3"))
    weather = X.as_of_origin(weather, origins, N.WEEKLY_LAG).drop("ds").where("region_code is not null")
    climate = X.climate_norms(_weather(spark, root), "t", X.month_spine(spark, FIRST, LAST_FUTURE), 2022, 2023).select(F.col("cell").alias("region_code"), "ds", F.col("norm").alias("climate_norm"))
    ids = table(spark, root, "oktmo_reference").where("territory_id is not null").select("territory_id").distinct()
    access = X.access_features(ids, ids.select("territory_id", ((F.col("territory_id") % 5) * 10.0).alias("access")), pairs)
    size = panel(spark, root).where("category = 'total'").groupBy("territory_id").agg(F.median("y").alias("population"))
    population = A.population_features(size, t)
    return {
        "calendar": X.Block("calendar", calendar, "known_future"), "climate": X.Block("climate", climate, "known_future", ("region_code",)),
        "macro": X.Block("macro", macro, "past_only"), "events": X.Block("events", events, "past_only", ("region_code",)), "coded": X.Block("coded", coded, "past_only"),
        "news": X.Block("news", both, "past_only", ("region_code",)), "neighbours": X.Block("neighbours", near, "past_only", ("territory_id", "category")),
        "weather": X.Block("weather", weather, "past_only", ("region_code",)), "access": X.Block("access", access, "static", ("territory_id",)), "population": X.Block("population", population, "static", ("territory_id",)),
    }


@query()
def feature_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Direct rows with all blocks: by block its columns, and the rows that got a value from it (one scan of a wide table: no SQL twin)."""
    p = panel(spark, root)
    blocks = {k: b for k, b in load_blocks(spark, root).items() if k != "news"}
    static = p.select("unique_id", "territory_id").distinct().join(territory(spark, root).select("territory_id", "region_code"), "territory_id", "left")
    rows = X.direct_rows(p, 3).select("unique_id", "category", "origin", "ds", "step", "target")
    wide = materialize(A.feature_table(rows, static, list(blocks.values())), "features")
    own = {k: [c for c in b.frame.columns if c not in b.keys] for k, b in blocks.items()}
    known = [F.count_if(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in cols]).isNotNull()).alias(k) for k, cols in own.items()]
    info = spark.createDataFrame([(k, blocks[k].kind, len(cols)) for k, cols in own.items()], "block string, kind string, columns int")
    counts = wide.agg(F.count("*").alias("rows"), *known).unpivot(["rows"], list(own), "block", "joined")
    return counts.join(F.broadcast(info), "block").select("block", "kind", "columns", "rows", "joined")  # a row per block
