"""Queries on residual streams, detectors and their scores, with SQL twins (recursive where needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators import changepoint as C
from kronopanel.operators import changepoint_grid as G
from kronopanel.operators.features import panel_seasonal_index
from kronopanel.plans.inputs import OOF_SQL, PANEL_SQL, Registry, numbered, oof, panel, r4, s4

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_NUM = f"""WITH RECURSIVE {PANEL_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY unique_id) AS n FROM panel)"""
_BENCH = (
    _NUM
    + """, bench AS (SELECT unique_id, territory_id, ds, t, n, y, CASE WHEN territory_id % 4 = 0 THEN -1 ELSE 6 + territory_id % 12 END AS tau FROM num WHERE n >= 20),
inj AS (SELECT unique_id, ds, t, n, tau, CASE WHEN tau < 0 OR t < tau THEN y WHEN territory_id % 4 = 1 THEN y * 1.4 WHEN territory_id % 4 = 2 THEN CASE WHEN t - tau < 3 THEN y * 0.5 ELSE y END
  ELSE y * (1 + 0.4 * least(1.0::DOUBLE, (t - tau + 1) / 3.0::DOUBLE)) END AS y FROM bench),
res AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id ORDER BY t) AS r FROM inj),
past AS (SELECT *, list(r) OVER (PARTITION BY unique_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l0 FROM res),
past2 AS (SELECT *, list_filter(l0, lambda x: x IS NOT NULL) AS l FROM past), med AS (SELECT *, CASE WHEN len(l) >= 3 THEN list_aggregate(l, 'median') END AS m FROM past2),
mad AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - m)), 'median') AS d FROM med),
z AS (SELECT unique_id, ds, t, n, tau, r, CASE WHEN m IS NOT NULL THEN r / greatest(CASE WHEN d > 0 THEN 1.4826 * d ELSE list_aggregate(l, 'stddev_pop') END, 1e-9) END AS z FROM mad),
x AS (SELECT unique_id, t, n, tau, round(coalesce(z, 0), 6) AS x FROM z)"""
)


def _bench(spark: SparkSession, root: str) -> DataFrame:
    """Panel series of at least 20 months with a deterministic break each (a quarter without)."""
    from pyspark.sql import Window

    p = numbered(panel(spark, root)).withColumn("n", F.count("*").over(Window.partitionBy("unique_id"))).where("n >= 20")
    g = F.col("territory_id") % 4
    p = p.withColumn("tau", F.when(g == 0, -1).otherwise(6 + F.col("territory_id") % 12))
    kind = F.when(g == 1, "level_shift").when(g == 2, "temporary_drop").otherwise("gradual_drift")
    delta = F.when(g == 2, 0.5).otherwise(0.4)
    return p.withColumn("y", C.injected(F.col("y"), F.col("t"), F.col("tau"), kind, delta, F.col("n"))).select("unique_id", "ds", "t", "n", "tau", "y")


def _stream(spark: SparkSession, root: str) -> DataFrame:
    b = _bench(spark, root)
    r = C.naive_residuals(b).withColumnRenamed("residual", "r").join(b.select("unique_id", "ds", "n", "tau"), ["unique_id", "ds"])
    return C.causal_zscores(r, "r", center=False)


def _arrays(spark: SparkSession, root: str) -> DataFrame:
    x = _stream(spark, root).withColumn("x", F.round(F.coalesce("z", F.lit(0.0)), 6))
    return C.series_arrays(x, "x", ["unique_id", "n", "tau"])


def _labels(spark: SparkSession, root: str) -> DataFrame:
    return _bench(spark, root).groupBy("unique_id").agg(F.max("tau").alias("tau"), F.max("n").alias("n_obs"))


@query(_BENCH + " SELECT unique_id, t, tau, round(y, 4) AS y FROM inj")
def inject_break(spark: SparkSession, root: str) -> DataFrame:
    return _bench(spark, root).select("unique_id", "t", "tau", *r4("y"))


_SEASONAL = f"""WITH {PANEL_SQL}, p0 AS (SELECT *, count(y) OVER (PARTITION BY unique_id, year(ds)) AS n, avg(y) OVER (PARTITION BY unique_id, year(ds)) AS mean FROM panel),
b AS (SELECT category, month(ds) AS month, median(y / nullif(mean, 0)) AS raw FROM p0 WHERE n = 12 GROUP BY ALL), i AS (SELECT category, month, raw / avg(raw) OVER (PARTITION BY category) AS s FROM b),
p1 AS (SELECT p.unique_id, p.ds, p.y, coalesce(i.s, 1.0) AS s FROM panel p LEFT JOIN i ON i.category = p.category AND i.month = month(p.ds))"""


@query(_SEASONAL + " SELECT unique_id, ds, (row_number() OVER w - 1)::INT AS t, round(y - lag(y) OVER w * s / greatest(lag(s) OVER w, 1e-9), 4) AS residual FROM p1 WINDOW w AS (PARTITION BY unique_id ORDER BY ds)")
def residual_stream(spark: SparkSession, root: str) -> DataFrame:
    p = panel(spark, root)
    return C.naive_residuals(p, panel_seasonal_index(p)).select("unique_id", "ds", "t", *r4("residual"))


@query(_BENCH + " SELECT unique_id, t, round(z, 4) AS z FROM z")
def causal_zscore(spark: SparkSession, root: str) -> DataFrame:
    return _stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), *r4("z"))


@query(f"WITH {OOF_SQL}, r AS (SELECT model, unique_id, ds, fold, y - y_hat AS r FROM oof), m AS (SELECT model, median(r) AS med, stddev_pop(r) AS sd FROM r GROUP BY 1), a AS (SELECT r.model, median(abs(r - med)) AS mad FROM r JOIN m USING (model) GROUP BY 1) SELECT r.model, unique_id, ds, fold, round(r / greatest(CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END, 1e-9), 4) AS z FROM r JOIN m USING (model) JOIN a USING (model)")
def standardized_residuals(spark: SparkSession, root: str) -> DataFrame:
    r = oof(spark, root).select("model", "unique_id", "ds", "fold", (F.col("y") - F.col("y_hat")).alias("r"))
    return C.standardized(r, "model", "r").select("model", "unique_id", "ds", "fold", *r4("z"))


@query(_NUM + """, d AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id ORDER BY t) AS d FROM num), a AS (SELECT unique_id, median(y) AS level, median(d) AS md, stddev_pop(d) AS sd, greatest(max(abs(y)), 1.0) * 1e-9 AS fl FROM d GROUP BY 1),
m AS (SELECT unique_id, median(abs(d - md)) AS mad FROM d JOIN a USING (unique_id) GROUP BY 1), s AS (SELECT *, CASE WHEN mad > fl THEN 1.4826 * mad ELSE sd END AS raw FROM a JOIN m USING (unique_id))
SELECT unique_id, t, round((y - level) / CASE WHEN raw > fl THEN raw / sqrt(2.0) ELSE 1.0 END, 4) AS x FROM num JOIN s USING (unique_id)""")
def noise_units(spark: SparkSession, root: str) -> DataFrame:
    return C.noise_units(numbered(panel(spark, root))).select("unique_id", F.col("t").cast("long").alias("t"), *r4("x"))


def _cusum_sql(thresholds: str) -> str:
    return f""", c AS (SELECT unique_id, thr, 0::BIGINT AS t, greatest(0.0::DOUBLE, 0.0 + x - 0.5) AS p, greatest(0.0::DOUBLE, 0.0 - x - 0.5) AS n FROM x, (VALUES {thresholds}) v(thr) WHERE t = 0
  UNION ALL SELECT c.unique_id, c.thr, x.t, greatest(0.0::DOUBLE, CASE WHEN greatest(p, c.n) > thr THEN 0.0 ELSE p END + x.x - 0.5), greatest(0.0::DOUBLE, CASE WHEN greatest(p, c.n) > thr THEN 0.0 ELSE c.n END - x.x - 0.5) FROM c JOIN x ON x.unique_id = c.unique_id AND x.t = c.t + 1)"""


@query(_BENCH + _cusum_sql("(5.0::DOUBLE)") + " SELECT unique_id, t::INT AS t FROM c WHERE greatest(p, n) > thr")
def cusum_alarms(spark: SparkSession, root: str) -> DataFrame:
    return C.cusum_alarms(_arrays(spark, root), 5.0).select("unique_id", F.explode("alarms").alias("t"))


@query(_BENCH + """, c AS (SELECT unique_id, 0::BIGINT AS t, 1 AS k, x AS m, x - x - 0.05 AS s, least(0.0::DOUBLE, x - x - 0.05) AS lo, greatest(0.0::DOUBLE, x - x - 0.05) AS hi, false AS a FROM x WHERE t = 0
  UNION ALL SELECT unique_id, t, CASE WHEN a2 THEN 0 ELSE k2 END, CASE WHEN a2 THEN 0.0 ELSE m2 END, CASE WHEN a2 THEN 0.0 ELSE s2 END, CASE WHEN a2 THEN 0.0 ELSE lo2 END, CASE WHEN a2 THEN 0.0 ELSE hi2 END, a2 FROM (
    SELECT *, greatest(s2 - lo2, hi2 - s2) > 5.0 AS a2 FROM (SELECT *, least(lo, s2) AS lo2, greatest(hi, s2) AS hi2 FROM (SELECT *, s + (xx - m2 - 0.05) AS s2 FROM (
      SELECT c.unique_id, x.t, x.x AS xx, c.k + 1 AS k2, c.m + (x.x - c.m) / (c.k + 1) AS m2, c.s, c.lo, c.hi FROM c JOIN x ON x.unique_id = c.unique_id AND x.t = c.t + 1)))))
SELECT unique_id, t::INT AS t FROM c WHERE a""")
def page_hinkley_alarms(spark: SparkSession, root: str) -> DataFrame:
    return C.page_hinkley_alarms(_arrays(spark, root), 5.0).select("unique_id", F.explode("alarms").alias("t"))


@query(_BENCH + """, f AS (SELECT unique_id, t, (abs(x) > 1.5)::INT AS flag FROM x), i AS (SELECT *, sum(1 - flag) OVER (PARTITION BY unique_id ORDER BY t) AS g FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY unique_id, g ORDER BY t) AS k FROM i WHERE flag = 1) SELECT unique_id, t FROM k WHERE k % 2 = 0""")
def conformal_alarms(spark: SparkSession, root: str) -> DataFrame:
    flags = _stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), (F.abs(F.round(F.coalesce("z", F.lit(0.0)), 6)) > 1.5).cast("int").alias("flag"))
    return C.conformal_alarms(flags, 2)


@query(_NUM + ", l AS (SELECT unique_id, count(*) AS n FROM num GROUP BY 1) SELECT unique_id, s.t FROM l, range(6, 1000, 6) s(t) WHERE s.t < n")
def schedule_alarms(spark: SparkSession, root: str) -> DataFrame:
    return C.schedule_alarms(panel(spark, root).groupBy("unique_id").agg(F.count("*").alias("n")), 6)


@query(_BENCH + ", b AS (SELECT unique_id, max(tau) AS tau FROM bench GROUP BY 1) SELECT x.unique_id, x.t, (b.tau >= 0 AND x.t < b.tau AND b.tau <= x.t + 1)::INT AS z_h1, (b.tau >= 0 AND x.t < b.tau AND b.tau <= x.t + 2)::INT AS z_h2, (b.tau >= 0 AND x.t < b.tau AND b.tau <= x.t + 3)::INT AS z_h3 FROM bench x JOIN b USING (unique_id)")
def hazard_labels(spark: SparkSession, root: str) -> DataFrame:
    b = _bench(spark, root)
    return C.hazard_labels(b.select("unique_id", F.col("t").cast("long").alias("t")), _labels(spark, root).select("unique_id", F.col("tau").cast("long").alias("tau")))


@query(_BENCH + f""", s AS (SELECT unique_id, t, z, (coalesce(z, 0) > 0)::INT AS up FROM z), u AS (SELECT *, (up <> coalesce(lag(up) OVER w, 1 - up))::INT AS turn FROM s WINDOW w AS (PARTITION BY unique_id ORDER BY t)), v AS (SELECT *, sum(turn) OVER (PARTITION BY unique_id ORDER BY t) AS run FROM u),
q AS (SELECT unique_id, t, {", ".join(f"avg(z) OVER w{w} AS resid_mean_{w}, avg(abs(z)) OVER w{w} AS resid_absmean_{w}, CASE WHEN count(z) OVER w{w} >= 2 THEN stddev_samp(z) OVER w{w} END AS resid_std_{w}" for w in (3, 6))}, z - lag(z) OVER (PARTITION BY unique_id ORDER BY t) AS resid_trend, row_number() OVER (PARTITION BY unique_id, run ORDER BY t)::INT AS resid_sign_run
  FROM v WINDOW w3 AS (PARTITION BY unique_id ORDER BY t ROWS 2 PRECEDING), w6 AS (PARTITION BY unique_id ORDER BY t ROWS 5 PRECEDING))
SELECT unique_id, t, {s4(*[f"resid_{a}_{w}" for w in (3, 6) for a in ("mean", "absmean", "std")], "resid_trend")}, resid_sign_run FROM q""")
def residual_trajectory(spark: SparkSession, root: str) -> DataFrame:
    out = C.residual_trajectory(_stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), "z"))
    return out.select("unique_id", "t", *r4(*[f"resid_{a}_{w}" for w in (3, 6) for a in ("mean", "absmean", "std")], "resid_trend"), "resid_sign_run")


@query(f"""WITH {OOF_SQL}, f AS (SELECT unique_id, ds, y_hat, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS t FROM (SELECT * FROM oof WHERE model = 'ets' QUALIFY row_number() OVER (PARTITION BY unique_id, ds, model ORDER BY horizon, cutoff DESC, fold) = 1)),
w AS (SELECT unique_id, t, (y_hat * 1.1 + t - y_hat * 0.9) / greatest(abs(y_hat), 1e-9) AS interval_width FROM f) SELECT unique_id, t, round(interval_width, 4) AS interval_width, round(interval_width - lag(interval_width) OVER (PARTITION BY unique_id ORDER BY t), 4) AS interval_width_change FROM w""")
def interval_width(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    from kronopanel.operators.backtest import freshest_forecast

    f = freshest_forecast(oof(spark, root).where("model = 'ets'")).withColumn("t", F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")).cast("long"))
    f = f.withColumn("lo", F.col("y_hat") * 0.9).withColumn("hi", F.col("y_hat") * 1.1 + F.col("t"))
    return C.interval_width(f, "lo", "hi", "y_hat").select("unique_id", "t", *r4("interval_width", "interval_width_change"))


_ALARMS = _BENCH + _cusum_sql("(5.0::DOUBLE)") + ", al AS (SELECT unique_id, list(t) AS a FROM c WHERE greatest(p, n) > thr GROUP BY 1), lab AS (SELECT unique_id, max(tau) AS tau, max(n) AS n_obs FROM bench GROUP BY 1), j AS (SELECT lab.*, coalesce(a, []) AS a FROM lab LEFT JOIN al USING (unique_id))"


@query(_ALARMS + """, d AS (SELECT *, list_min(list_filter(a, lambda x: x >= tau)) AS af, list_max(list_filter(a, lambda x: x < tau)) AS be FROM j WHERE tau >= 0)
SELECT unique_id, tau, (af - tau)::INT AS delay, af IS NOT NULL AS detected, list_min(a)::INT AS first_alarm, (tau - be)::INT AS lead_time FROM d""")
def detection_delays(spark: SparkSession, root: str) -> DataFrame:
    alarms = C.cusum_alarms(_arrays(spark, root), 5.0).select("unique_id", "alarms")
    return C.detection_delays(alarms, _labels(spark, root))


@query(_ALARMS + """, k AS (SELECT *, (tau >= 0)::INT AS tr, len(a) AS pr, (tau >= 0 AND len(list_filter(a, lambda x: abs(x - tau) <= 1)) > 0)::INT AS m, len(list_filter(a, lambda x: tau < 0 OR abs(x - tau) > 1)) AS f FROM j),
s AS (SELECT sum(tr)::BIGINT AS n_true, sum(pr)::BIGINT AS n_pred, sum(m)::BIGINT AS matched, sum(f) / (sum(n_obs) / 12.0) AS fy FROM k)
SELECT n_true, n_pred, matched, round(matched / n_pred, 4) AS precision, round(matched / n_true, 4) AS recall, round(2.0 * matched / (n_pred + n_true), 4) AS f1, round(fy, 4) AS false_per_year FROM s""")
def detector_score(spark: SparkSession, root: str) -> DataFrame:
    alarms = C.cusum_alarms(_arrays(spark, root), 5.0).select("unique_id", "alarms")
    return C.score(alarms, _labels(spark, root)).select("n_true", "n_pred", "matched", *r4("precision", "recall", "f1", "false_per_year"))


@query(_BENCH + _cusum_sql("(2.0::DOUBLE), (3.0), (5.0), (8.0), (12.0)") + """, al AS (SELECT unique_id, thr, list(t) AS a FROM c WHERE greatest(p, n) > thr GROUP BY 1, 2), lab AS (SELECT unique_id, thr, max(tau) AS tau FROM bench, (VALUES (2.0::DOUBLE), (3.0), (5.0), (8.0), (12.0)) v(thr) GROUP BY 1, 2),
j AS (SELECT lab.*, coalesce(a, []) AS a FROM lab LEFT JOIN al USING (unique_id, thr)), s AS (SELECT thr, sum((tau >= 0)::INT)::BIGINT AS n_true, sum(len(a))::BIGINT AS n_pred, sum((tau >= 0 AND len(list_filter(a, lambda x: abs(x - tau) <= 1)) > 0)::INT)::BIGINT AS matched FROM j GROUP BY 1)
SELECT thr AS threshold, n_true, n_pred, matched, CASE WHEN matched > 0 THEN round(2.0 * matched / (n_pred + n_true), 4) ELSE 0.0 END AS f1 FROM s""")
def detector_calibration(spark: SparkSession, root: str) -> DataFrame:
    """F1 of the detector over its threshold grid, all thresholds in one pass."""
    grid = _arrays(spark, root).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (2.0, 3.0, 5.0, 8.0, 12.0)])))
    found = C.cusum_alarms(grid, F.col("threshold"))
    per = found.select("threshold", (F.col("tau") >= 0).cast("int").alias("tr"), F.size("alarms").alias("pr"), C.match_within(F.when(F.col("tau") >= 0, F.array(F.col("tau").cast("int"))).otherwise(F.array().cast("array<int>")), F.col("alarms"), 1).alias("m"))
    s = per.groupBy("threshold").agg(F.sum("tr").alias("n_true"), F.sum("pr").alias("n_pred"), F.sum("m").alias("matched"))
    return s.withColumn("f1", F.when(F.col("matched") > 0, 2.0 * F.col("matched") / (F.col("n_pred") + F.col("n_true"))).otherwise(0.0)).select("threshold", "n_true", "n_pred", "matched", *r4("f1"))


@query(_ALARMS + """, seg AS (SELECT unique_id, n_obs, list_sort(list_distinct(list_concat([0::BIGINT, n_obs], list_filter([tau], lambda t: t > 0 AND t < n_obs)))) AS tb, list_sort(list_distinct(list_concat([0::BIGINT, n_obs], list_filter(a, lambda t: t > 0 AND t < n_obs)))) AS pb FROM j),
ts AS (SELECT unique_id, n_obs, pb, tb[i] AS a, tb[i + 1] AS b FROM (SELECT *, unnest(range(1, len(tb))) AS i FROM seg)), ps AS (SELECT unique_id, a, b, pb[i] AS pa, pb[i + 1] AS pe, n_obs FROM (SELECT *, unnest(range(1, len(pb))) AS i FROM ts)),
o AS (SELECT unique_id, n_obs, a, b, max(greatest(0, least(b, pe) - greatest(a, pa)) / (greatest(b, pe) - least(a, pa))::DOUBLE) AS best FROM ps GROUP BY ALL) SELECT unique_id, round(sum((b - a) * best) / any_value(n_obs), 4) AS covering FROM o GROUP BY 1""")
def segment_covering(spark: SparkSession, root: str) -> DataFrame:
    r = C.cusum_alarms(_arrays(spark, root), 5.0)
    return C.covering(r, F.array(F.col("tau").cast("int")), F.col("alarms"), F.col("n")).select("unique_id", *r4("covering"))


@query(_BENCH + """, lab AS (SELECT unique_id, max(tau) AS tau, max(n) AS n_obs FROM bench GROUP BY 1), p AS (SELECT period, l.*, s.t FROM (VALUES (2), (3), (4), (5), (6), (8), (12)) v(period), lab l, range(1, 1000) s(t) WHERE s.t % period = 0 AND s.t < l.n_obs),
y AS (SELECT sum(n_obs) / 12.0 AS years FROM lab), r AS (SELECT period, count(*) FILTER (tau < 0 OR abs(t - tau) > 1) / any_value(years) AS rate FROM p, y GROUP BY 1)
SELECT period, round(rate, 4) AS rate FROM r ORDER BY abs(rate - 1.0), period DESC LIMIT 1""")
def schedule_at_equal_rate(spark: SparkSession, root: str) -> DataFrame:
    """The alarm schedule whose false-alarm rate is nearest to one a year."""
    lab = _labels(spark, root).withColumnRenamed("n_obs", "n")
    years = lab.agg((F.sum("n") / 12.0).alias("years"))
    s = lab.withColumn("period", F.explode(F.array(*[F.lit(p) for p in (2, 3, 4, 5, 6, 8, 12)])))
    s = s.withColumn("t", F.explode(F.when(F.col("n") > F.col("period"), F.sequence(F.col("period").cast("long"), F.col("n").cast("long") - 1, F.col("period").cast("long")))))
    false = F.count_if((F.col("tau") < 0) | (F.abs(F.col("t") - F.col("tau")) > 1))
    rates = s.groupBy("period").agg(false.alias("k")).crossJoin(F.broadcast(years)).select("period", (F.col("k") / F.col("years")).alias("rate"))
    return C.nearest_rate(rates, 1.0).select("period", *r4("rate"))


def _noise_arrays(spark: SparkSession, root: str) -> DataFrame:
    return C.series_arrays(C.noise_units(_bench(spark, root)), "x")


def _detector(name: str, parameter: float, stream: bool):  # noqa: ANN202
    def run(spark: SparkSession, root: str) -> DataFrame:
        arrays = _arrays(spark, root) if stream else _noise_arrays(spark, root)
        return C.detect(arrays, name, parameter).select("unique_id", F.explode("alarms").alias("t"))

    run.__name__ = f"{name}_alarms"
    run.__doc__ = f"Alarms of the sequential detector {name} (iterative: no SQL twin)."
    return run


for _name, _parameter, _on_stream in (("pelt_l2", 30.0, False), ("pelt_rbf", 3.0, False), ("kernel_rbf", 3.0, False), ("binseg_l2", 30.0, False), ("window_l2", 20.0, False), ("bocpd", 0.25, True)):
    query()(_detector(_name, _parameter, _on_stream))


# -- all detectors over their grids --------------------------------------------------------------------

#: The parameters each detector is tried with.
ONLINE_GRID = {"cusum": (2, 3, 5, 8, 12), "page_hinkley": (3, 5, 8, 12, 20), "bocpd": (0.15, 0.2, 0.25, 0.3, 0.4, 0.5), "adwin": (0.05, 0.01, 0.002, 0.0005), "conformal": (1.5, 2.0, 2.5, 3.0)}
OFFLINE_GRID = {"pelt_l2": (3, 10, 30, 100, 300), "pelt_rbf": (1, 3, 10), "kernel_rbf": (1, 3, 10), "binseg_l2": (3, 10, 30, 100, 300), "window_l2": (3, 10, 30, 100)}


def _raw_stream(spark: SparkSession, root: str) -> DataFrame:
    """Values against the median of their own past: the stream of detectors that see no forecast."""
    return C.causal_zscores(_bench(spark, root), "y", center=True)


def _raw_arrays(spark: SparkSession, root: str) -> DataFrame:
    return C.series_arrays(_raw_stream(spark, root).withColumn("x", F.round(F.coalesce("z", F.lit(0.0)), 6)), "x", ["unique_id"])


@query(_BENCH.replace("res AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id ORDER BY t) AS r FROM inj)", "res AS (SELECT *, y AS r FROM inj)").replace("CASE WHEN m IS NOT NULL THEN r / greatest(", "CASE WHEN m IS NOT NULL THEN (r - m) / greatest(") + " SELECT unique_id, t, round(z, 4) AS z FROM z")
def raw_zscore(spark: SparkSession, root: str) -> DataFrame:
    return _raw_stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), *r4("z"))


@query()
def adwin_alarms(spark: SparkSession, root: str) -> DataFrame:
    """Alarms of the adaptive window on the stream of values (iterative: no SQL twin)."""
    return C.detect(_raw_arrays(spark, root), "adwin", 0.05).select("unique_id", F.explode("alarms").alias("t"))


def _grid_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every detector on its streams: the bench is read once, the streams are made series by series."""
    from kronopanel.session import materialize

    ys = F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("ys")
    series = _bench(spark, root).groupBy("unique_id").agg(ys, F.max("tau").alias("tau"), F.max("n").alias("n_obs"))
    return materialize(G.grid_counts(series, {"residual": ONLINE_GRID, "raw": ONLINE_GRID, "noise units": OFFLINE_GRID}), "grid-counts")


@query()
def calibrated_detectors(spark: SparkSession, root: str) -> DataFrame:
    """Every detector and input: parameter by F1 on half the series, scores on the other half (hash split: no SQL twin)."""
    out = G.calibrated_counts(_grid_counts(spark, root))
    return out.select("detector", "parameter", *r4("f1_calibration", "f1", "precision", "recall", "false_per_year"), "n_true", "n_pred")


@query()
def delay_curve(spark: SparkSession, root: str) -> DataFrame:
    """Delay against false alarms for every detector and parameter (iterative detectors: no SQL twin)."""
    return G.delay_counts(_grid_counts(spark, root)).select("detector", "parameter", *r4("false_per_year", "recall", "mean_delay"), "detected")


_LIVE = f"""WITH RECURSIVE {OOF_SQL}, f AS (SELECT * FROM (SELECT * FROM oof WHERE model = 'ets' AND horizon <= 3) QUALIFY row_number() OVER (PARTITION BY unique_id, ds, model ORDER BY horizon, cutoff DESC, fold) = 1),
r AS (SELECT unique_id, ds, y, y_hat, y - y_hat AS r, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t FROM f), m AS (SELECT median(r) AS med, stddev_pop(r) AS sd FROM r), d AS (SELECT median(abs(r - med)) AS mad FROM r, m),
x AS (SELECT unique_id, ds, t, y, y_hat, r, round(r / greatest(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END, 1e-9), 6) AS x FROM r, m, d)"""


def _live(spark: SparkSession, root: str) -> DataFrame:
    """The stream a live detector sees: one forecast per month, the shortest of at most three months, in units of its usual error."""
    from pyspark.sql import Window

    from kronopanel.operators.backtest import freshest_forecast

    f = freshest_forecast(oof(spark, root).where("model = 'ets'"), 3)
    f = f.select("unique_id", "ds", "y", "y_hat", (F.col("y") - F.col("y_hat")).alias("r"), F.lit("ets").alias("model"), (F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")) - 1).alias("t"))
    m = f.agg(F.median("r").alias("med"), F.stddev_pop("r").alias("sd"))
    d = f.crossJoin(F.broadcast(m)).agg(F.median(F.abs(F.col("r") - F.col("med"))).alias("mad"), F.max("sd").alias("sd"))  # one row
    scale = F.greatest(F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd")), F.lit(1e-9))
    return f.crossJoin(F.broadcast(d)).withColumn("x", F.round(F.col("r") / scale, 6))


@query(_LIVE + _cusum_sql("(3.0::DOUBLE)") + " SELECT c.unique_id, x.ds::VARCHAR AS ds, c.t::INT AS t FROM c JOIN x ON x.unique_id = c.unique_id AND x.t = c.t WHERE greatest(p, n) > thr")
def live_alarms(spark: SparkSession, root: str) -> DataFrame:
    """Alarms on the residuals of real forecasts, with their months."""
    s = _live(spark, root)
    a = C.cusum_alarms(C.series_arrays(s, "x"), 3.0).select("unique_id", F.explode("alarms").alias("t"))
    return a.join(s.select("unique_id", "t", "ds"), ["unique_id", "t"]).select("unique_id", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "t")


@query(_LIVE + _cusum_sql("(3.0::DOUBLE)") + """, a AS (SELECT unique_id, count(*) AS k FROM c WHERE greatest(p, n) > thr GROUP BY 1)
SELECT count(DISTINCT unique_id) AS series, round(count(*) / count(DISTINCT unique_id), 4) AS months_per_series, (SELECT coalesce(sum(k), 0)::BIGINT FROM a) AS alarms, (SELECT count(*) FROM a) AS series_with_alarm, round(avg((r > 0)::INT), 4) AS above_forecast FROM x""")
def live_summary(spark: SparkSession, root: str) -> DataFrame:
    s = _live(spark, root)
    k = C.cusum_alarms(C.series_arrays(s, "x"), 3.0).agg(F.sum(F.size("alarms")).cast("long").alias("alarms"), F.count_if(F.size("alarms") > 0).alias("series_with_alarm"))
    a = s.agg(F.count_distinct("unique_id").alias("series"), (F.count("*") / F.count_distinct("unique_id")).alias("months_per_series"), F.avg((F.col("r") > 0).cast("int")).alias("above_forecast"))
    return a.crossJoin(k).select("series", *r4("months_per_series"), "alarms", "series_with_alarm", *r4("above_forecast"))  # one row each


@query(_LIVE + """, f2 AS (SELECT unique_id, t, ds, (y < y_hat * 0.9 OR y > y_hat * 1.1)::INT AS flag FROM x), i AS (SELECT *, sum(1 - flag) OVER (PARTITION BY unique_id ORDER BY t) AS g FROM f2), k AS (SELECT *, row_number() OVER (PARTITION BY unique_id, g ORDER BY t) AS k FROM i WHERE flag = 1) SELECT unique_id, t FROM k WHERE k % 2 = 0""")
def interval_alarms(spark: SparkSession, root: str) -> DataFrame:
    """Two actuals in a row outside a band of a tenth around the forecast."""
    s = _live(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), C.exceedance(F.col("y"), F.col("y_hat") * 0.9, F.col("y_hat") * 1.1).alias("flag"))
    return C.conformal_alarms(s, 2)


@query(_BENCH + " SELECT unique_id, t, (abs(x) > 1.5)::INT AS flag, max((abs(x) > 1.5)::INT) OVER (PARTITION BY unique_id ORDER BY t ROWS 2 PRECEDING) AS flag_recent FROM x")
def recent_alarms(spark: SparkSession, root: str) -> DataFrame:
    flags = _stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), (F.abs(F.round(F.coalesce("z", F.lit(0.0)), 6)) > 1.5).cast("int").alias("flag"))
    return C.recent_alarm(flags, "flag")


@query(_ALARMS + """, k AS (SELECT split_part(unique_id, '__', 1)::INT % 4 AS shape, (len(list_filter(a, lambda x: abs(x - tau) <= 1)) > 0)::INT AS m FROM j WHERE tau >= 0) SELECT shape, count(*) AS n_true, sum(m)::BIGINT AS matched, round(avg(m), 4) AS recall FROM k GROUP BY 1""")
def recall_by_shape(spark: SparkSession, root: str) -> DataFrame:
    """Recall of the sums by the shape of the break."""
    r = C.cusum_alarms(_arrays(spark, root), 5.0).where("tau >= 0")
    hit = C.match_within(F.array(F.col("tau").cast("int")), F.col("alarms"), 1)
    return r.groupBy((F.split_part("unique_id", F.lit("__"), F.lit(1)).cast("int") % 4).alias("shape")).agg(F.count("*").alias("n_true"), F.sum(hit).alias("matched"), F.avg(hit).alias("recall")).select("shape", "n_true", "matched", *r4("recall"))


@query(_ALARMS + """, w AS (SELECT unique_id, n_obs, unnest(a) AS c FROM j), p AS (SELECT DISTINCT unique_id, unnest(range(greatest(0, c - 1), least(n_obs - 1, c + 1) + 1)) AS t FROM w) SELECT j.unique_id, round(count(p.t) / any_value(j.n_obs), 4) AS coverage FROM j LEFT JOIN p USING (unique_id) GROUP BY 1""")
def window_coverage(spark: SparkSession, root: str) -> DataFrame:
    r = C.cusum_alarms(_arrays(spark, root), 5.0)
    return r.select("unique_id", C.window_coverage(F.col("alarms"), F.col("n"), 1).alias("coverage")).select("unique_id", *r4("coverage"))


@query(_ALARMS + """, ok AS (SELECT min(unique_id) AS u FROM j WHERE tau >= 0 AND split_part(unique_id, '__', 1)::INT % 4 = 1 AND len(list_filter(a, lambda x: x >= tau AND x <= tau + 3)) > 0) SELECT x.unique_id, x.t, x.tau, round(x.x, 4) AS x FROM x JOIN ok ON x.unique_id = ok.u""")
def detector_demo(spark: SparkSession, root: str) -> DataFrame:
    """The stream of the first level shift that was noticed within three months."""
    from kronopanel.session import materialize

    r = materialize(_arrays(spark, root), "streams")
    seen = C.cusum_alarms(r, 5.0).where("tau >= 0 and int(split_part(unique_id, '__', 1)) % 4 = 1").where(F.exists("alarms", lambda a: (a >= F.col("tau")) & (a <= F.col("tau") + 3)))
    first = seen.agg(F.min("unique_id").alias("unique_id"))
    rows = r.join(F.broadcast(first), "unique_id").select("unique_id", "tau", F.explode("xs").alias("c"))  # one row
    return rows.select("unique_id", F.col("c.t").cast("long").alias("t"), "tau", F.col("c.x").alias("x")).select("unique_id", "t", "tau", *r4("x"))


@query()
def recall_gap(spark: SparkSession, root: str) -> DataFrame:
    """Recall of two detectors on the same breaks, with a paired bootstrap interval (seeded draws: no SQL twin).

    Breaks are counted by the pair of outcomes, of which there are four; the bootstrap draws those counts.
    """
    import numpy as np

    r = _arrays(spark, root).where("tau >= 0")
    hit = lambda df, c: df.select("unique_id", (C.match_within(F.array(F.col("tau").cast("int")), F.col("alarms"), 1) > 0).cast("int").alias(c))
    n = hit(C.cusum_alarms(r, 5.0), "a").join(hit(C.page_hinkley_alarms(r, 5.0), "b"), "unique_id").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy("a", "b").collect()
    total, weight, gap = sum(x.n for x in n), np.array([x.n for x in n], float), np.array([x.a - x.b for x in n], float)
    draws = np.random.default_rng(0).multinomial(total, weight / max(total, 1), 2000) @ gap / max(total, 1) if total else np.zeros(1)
    row = (float(weight @ gap / max(total, 1)), float(np.quantile(draws, 0.025)), float(np.quantile(draws, 0.975)), total)
    return spark.createDataFrame([row], "gap double, low double, high double, breaks long").select(*r4("gap", "low", "high"), "breaks")


@query()
def variance_jumps(spark: SparkSession, root: str) -> DataFrame:
    """Panel series with a jump of the variance from the tenth month on (hashed draws: no SQL twin)."""
    from pyspark.sql import Window

    own = Window.partitionBy("unique_id")
    p = numbered(panel(spark, root)).withColumn("n", F.count("*").over(own)).where("n >= 20").withColumn("tau", F.lit(10))
    p = p.withColumn("spread", C.spread_before(F.col("y"), F.col("t"), F.col("tau"), own)).withColumn("draw", C.normal_draw(7, "unique_id", "t"))
    y = C.injected(F.col("y"), F.col("t"), F.col("tau"), F.lit("variance_jump"), F.lit(2.0), F.col("n"), draw=F.col("draw"), spread=F.col("spread"))
    return p.withColumn("y", y).select("unique_id", "t", *r4("y"))
