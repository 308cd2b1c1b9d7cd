"""Queries on assembled features and report tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators import assembly as A
from kronopanel.operators import changepoint as C
from kronopanel.operators import features as X
from kronopanel.operators.metrics import loss_differences
from kronopanel.plans.backtest_queries import _PAIRS, _reference_oof
from kronopanel.plans.changepoint_queries import _BENCH, _cusum_sql, _labels, _noise_arrays, _arrays, _stream
from kronopanel.plans.inputs import PANEL_SQL, TERRITORY_SQL, Registry, edges, numbered, panel, r4, territory
from kronopanel.plans.panel_queries import _LAGS_SQL, _NN_SQL
from kronopanel.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(_LAGS_SQL.replace("WITH ", f"WITH {TERRITORY_SQL}, {_NN_SQL}, ", 1) + """, o AS (SELECT w.*, 1::BIGINT AS step, (w.ds + INTERVAL 1 MONTH)::DATE AS target_ds FROM w WHERE n_history >= 7),
q AS (SELECT territory_id, category, ds, ln(y) AS l, ln(y) - max(ln(y)) OVER (PARTITION BY territory_id, category ORDER BY year(ds) * 12 + month(ds) RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS g1 FROM panel WHERE y > 0),
a AS (SELECT nn.x, q.category, q.ds, avg(q.g1) AS g FROM nn JOIN q ON q.territory_id = nn.y GROUP BY ALL), m AS (SELECT ds, avg(y) AS nat FROM panel WHERE category = 'total' GROUP BY 1)
SELECT o.unique_id, o.ds AS origin, p.ds, round(ln((p.y + 1) / (o.y + 1)), 4) AS target, t.region_code, round(m.nat, 4) AS national, round(a.g, 4) AS neighbour_growth FROM o JOIN panel p ON p.unique_id = o.unique_id AND p.ds = o.target_ds
LEFT JOIN territory t ON t.territory_id = p.territory_id LEFT JOIN m ON last_day(m.ds) + 35 <= last_day(o.ds) AND NOT EXISTS (SELECT 1 FROM m m2 WHERE m2.ds > m.ds AND last_day(m2.ds) + 35 <= last_day(o.ds))
LEFT JOIN a ON a.x = p.territory_id AND a.category = p.category AND a.ds = o.ds""")
def assembled_features(spark: SparkSession, root: str) -> DataFrame:
    """Direct rows with static attributes, a lagged national block and a neighbour block."""
    p = panel(spark, root)
    rows = X.direct_rows(p, 1).drop("category")
    static = p.select("unique_id", "territory_id", "category").distinct().join(territory(spark, root).select("territory_id", "region_code"), "territory_id", "left")
    monthly = p.where("category = 'total'").groupBy("ds").agg(F.avg("y").alias("national"))
    nat = X.as_of_origin(monthly, p.select(F.col("ds").alias("origin")).distinct(), 35).select("origin", "national")
    near = X.neighbour_features(p, X.nearest_neighbours(edges(spark, root), 3), lags=(1,)).select("territory_id", "category", F.col("ds").alias("origin"), F.col("neighbour_growth_1").alias("neighbour_growth"))
    out = A.feature_table(rows, static, [X.Block("national", nat, "past_only"), X.Block("near", near, "past_only", ("territory_id", "category"))])
    return out.select("unique_id", "origin", "ds", *r4("target"), "region_code", *r4("national", "neighbour_growth"))


@query("""WITH r AS (SELECT series_key, reading_id, (value IS NOT NULL AND NOT isnan(value))::INT AS k FROM national_series), i AS (SELECT *, sum(1 - k) OVER (PARTITION BY series_key ORDER BY reading_id) AS g FROM r)
SELECT series_key, min(reading_id) AS first, max(reading_id) AS last, count(*) AS n FROM i WHERE k = 1 GROUP BY series_key, g""")
def known_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of consecutive readings with a value."""
    n = table(spark, root, "national_series").select("series_key", "reading_id", "value")
    return A.value_runs(n, "series_key", "reading_id", F.col("value").isNotNull() & ~F.coalesce(F.isnan("value"), F.lit(False)))


@query(f"""WITH {PANEL_SQL}, {TERRITORY_SQL}, s AS (SELECT p.unique_id, t.region_code, median(p.y) AS size FROM panel p JOIN territory t USING (territory_id) GROUP BY ALL)
SELECT unique_id, region_code, round(size, 4) AS size FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY region_code ORDER BY size DESC, unique_id) = 1) ORDER BY size DESC, unique_id LIMIT 10""")
def showcase_series(spark: SparkSession, root: str) -> DataFrame:
    """The largest series of each region, and the ten largest of those (a top-k report)."""
    s = panel(spark, root).join(territory(spark, root).select("territory_id", "region_code"), "territory_id").groupBy("unique_id", "region_code").agg(F.median("y").alias("size"))
    return A.largest_per_group(s, "region_code", "size", 10).select("unique_id", "region_code", *r4("size"))


@query(f"""WITH {PANEL_SQL}, {TERRITORY_SQL}, s AS (SELECT p.unique_id, p.category, t.region_code, count(*) AS n FROM panel p JOIN territory t USING (territory_id) GROUP BY ALL) SELECT region_code, category, arg_max(unique_id, (n, unique_id)) AS unique_id, max(n) AS n FROM s GROUP BY ALL""")
def explorer_series(spark: SparkSession, root: str) -> DataFrame:
    """One series, the longest, for each region and category."""
    s = panel(spark, root).join(territory(spark, root).select("territory_id", "region_code"), "territory_id").groupBy("unique_id", "category", "region_code").agg(F.count("*").alias("n"))
    return s.groupBy("region_code", "category").agg(F.max_by("unique_id", F.struct("n", "unique_id")).alias("unique_id"), F.max("n").alias("n"))


@query("WITH m AS (SELECT DISTINCT unique_id, 'n-' || unique_id AS new_id FROM oof_old) SELECT new_id, count(*) AS n FROM oof_old JOIN m USING (unique_id) GROUP BY 1")
def rekeyed_forecasts(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "oof_old").select("unique_id", "ds")
    m = o.select("unique_id").distinct().withColumn("new_id", F.concat(F.lit("n-"), "unique_id"))
    return A.rekey(o, m, "unique_id", "new_id").groupBy("new_id").agg(F.count("*").alias("n"))


@query(_PAIRS + """, w AS (SELECT split_part(fold, '_', 1) AS pair, fold, avg(d) AS d FROM d GROUP BY ALL), m AS (SELECT pair, avg(d) AS mean, count(*) FILTER (d < 0) AS lower, count(*) FILTER (d > 0) AS higher FROM w GROUP BY 1),
p AS (SELECT *, CASE WHEN mean < 0 THEN lower ELSE higher END AS agreeing, least(1.0, 2 * list_sum(list_transform(range(0, least(lower, higher) + 1), lambda i: (factorial((lower + higher)::INT) / (factorial(i::INT) * factorial((lower + higher - i)::INT)))::DOUBLE)) / power(2, lower + higher)) AS sign_p FROM m)
SELECT pair, round(mean, 4) AS mean, agreeing, round(sign_p, 4) AS sign_p, sign_p < 0.05 AS steady FROM p""")
def steady_differences(spark: SparkSession, root: str) -> DataFrame:
    """Whether a difference between two models keeps its sign over the windows of a horizon."""
    d = loss_differences(_reference_oof(spark, root), "seasonal_naive", "naive")
    w = d.groupBy(F.split_part("fold", F.lit("_"), F.lit(1)).alias("pair"), "fold").agg(F.avg("d").alias("d"))
    return A.steady_differences(w, "pair", "d").select("pair", *r4("mean"), "agreeing", *r4("sign_p"), "steady")


_ALARM_MONTHS = _BENCH + _cusum_sql("(8.0::DOUBLE)") + ", al AS (SELECT DISTINCT z.ds FROM c JOIN z ON z.unique_id = c.unique_id AND z.t = c.t WHERE greatest(p, c.n) > thr)"


@query(_ALARM_MONTHS + """, mo AS (SELECT DISTINCT year(ds) * 12 + month(ds) + k AS m FROM al, (VALUES (-1), (0), (1)) v(k)), e AS (SELECT DISTINCT event_id, kind, year(date) * 12 + month(date) AS m FROM event_calendar WHERE date IS NOT NULL AND region_code = 'all')
SELECT kind, count(*) AS events, count(mo.m) AS hits, round(count(mo.m) / count(*)::DOUBLE, 4) AS share FROM e LEFT JOIN mo USING (m) GROUP BY 1""")
def national_event_hits(spark: SparkSession, root: str) -> DataFrame:
    """National events with an alarm of the panel within a month, by kind."""
    a = C.cusum_alarms(_arrays(spark, root), 8.0).select("unique_id", F.explode("alarms").alias("t"))
    months = a.join(_stream(spark, root).select("unique_id", "t", "ds"), ["unique_id", "t"]).select("ds").distinct()
    e = table(spark, root, "event_calendar").where("date is not null and region_code = 'all'").select("event_id", "kind", "date").distinct()
    return A.event_hits(e, months, 1).select("kind", "events", "hits", *r4("share"))


@query(_BENCH + """, zz AS (SELECT z.unique_id, z.ds, z.z, split_part(z.unique_id, '__', 2) AS category FROM z WHERE z IS NOT NULL), top AS (SELECT category, arg_max(unique_id, (abs(round(z, 6)), unique_id, ds)) AS unique_id, arg_max(ds, (abs(round(z, 6)), unique_id, ds)) AS ds, max(abs(round(z, 6))) AS size FROM zz GROUP BY 1),
k AS (SELECT date_trunc('month', date)::DATE AS ds, count(DISTINCT kind) AS kinds FROM event_calendar WHERE date IS NOT NULL GROUP BY 1) SELECT category, unique_id, top.ds, round(size, 4) AS size, kinds FROM top LEFT JOIN k USING (ds)""")
def strongest_residuals(spark: SparkSession, root: str) -> DataFrame:
    """The strongest residual of each category, and how many kinds of events fell into its month."""
    s = _stream(spark, root).where("z is not null").select("unique_id", "ds", F.round("z", 6).alias("z"), F.split_part("unique_id", F.lit("__"), F.lit(2)).alias("region_code"))
    e = table(spark, root, "event_calendar").where("date is not null")
    kinds = e.select("date", "kind").crossJoin(F.broadcast(s.select("region_code").distinct()))  # six categories
    out = A.strongest_event(s, kinds)
    return out.select(F.col("region_code").alias("category"), "unique_id", "ds", F.abs("z").alias("size"), F.size("kinds").cast("long").alias("k")).select("category", "unique_id", "ds", *r4("size"), F.when(F.col("k") >= 0, F.col("k")).alias("kinds"))


@query(f"""WITH {TERRITORY_SQL}, pop AS (SELECT territory_id, (territory_id * 37 % 1000 + 1) * 100.0 AS population FROM territory WHERE territory_id % 10 > 0)
SELECT territory_id, round(ln(population), 4) AS log_population, round(population / sum(population) OVER (PARTITION BY region_code), 4) AS region_share FROM territory LEFT JOIN pop USING (territory_id)""")
def population_features(spark: SparkSession, root: str) -> DataFrame:
    t = territory(spark, root)
    pop = t.where("territory_id % 10 > 0").select("territory_id", ((F.col("territory_id") * 37 % 1000 + 1) * 100.0).alias("population"))
    kept = A.gated(pop, t, "territory_id", 0.8)
    return A.population_features(kept, t).select("territory_id", *r4("log_population", "region_share"))


@query(_BENCH + """, f AS (SELECT t, count(DISTINCT n) AS a, count(DISTINCT unique_id) AS b, count(DISTINCT CASE WHEN t > 3 THEN 1 ELSE 0 END) AS c FROM z GROUP BY 1), s AS (SELECT avg((a <= 1)::INT) AS n, avg((b <= 1)::INT) AS unique_id, avg((c <= 1)::INT) AS late FROM f)
SELECT feature, round(share, 4) AS share FROM (UNPIVOT s ON n, unique_id, late INTO NAME feature VALUE share) WHERE share >= 0.99""")
def invariant_features(spark: SparkSession, root: str) -> DataFrame:
    """Features that do not vary between series at one position."""
    s = _stream(spark, root).withColumn("late", (F.col("t") > 3).cast("int"))
    return C.invariant_features(s, ["n", "unique_id", "late"]).select("feature", *r4("share"))


@query()
def pseudo_labels(spark: SparkSession, root: str) -> DataFrame:
    """Break points of the best offline detector as labels of the whole panel (dynamic programming: no SQL twin).

    The detector is chosen on the synthetic breaks and then run on the series as they are, of any length.
    """
    bench, labels = _noise_arrays(spark, root), _labels(spark, root)
    parameters = {"pelt_l2": 30.0, "binseg_l2": 30.0}
    f1 = {name: C.score(C.detect(bench, name, p), labels).first().f1 for name, p in parameters.items()}
    best = max(sorted(f1), key=lambda n: f1[n])
    real = C.series_arrays(C.noise_units(numbered(panel(spark, root))), "x")
    return C.detect(real, best, parameters[best]).select("unique_id", F.explode("alarms").alias("t"), F.lit(best).alias("detector"))


@query()
def detector_board(spark: SparkSession, root: str) -> DataFrame:
    """Scores of the detectors, the best three and the schedule whatever its rank (iterative: no SQL twin)."""
    labels = _labels(spark, root)
    noise, stream = _noise_arrays(spark, root), _arrays(spark, root)
    parts = {"schedule": C.schedule_alarms(labels.select("unique_id", F.col("n_obs").alias("n")), 6).groupBy("unique_id").agg(F.collect_list(F.col("t").cast("int")).alias("alarms")), "cusum": C.cusum_alarms(stream, 5.0).select("unique_id", "alarms"), "page_hinkley": C.page_hinkley_alarms(stream, 5.0).select("unique_id", "alarms"), **{n: C.detect(noise, n, p) for n, p in (("pelt_l2", 30.0), ("window_l2", 20.0), ("binseg_l2", 30.0))}}
    out = None
    for name, alarms in parts.items():
        s = C.score(alarms, labels).withColumn("detector", F.lit(name))
        out = s if out is None else out.unionByName(s)
    board = out.select("detector", *r4("precision", "recall", "f1", "false_per_year"))
    return A.top_with_baseline(board, "f1", 3, F.col("detector") == "schedule")
