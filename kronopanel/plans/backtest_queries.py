"""Queries on folds, forecasts, metrics and run comparison, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators import backtest as B
from kronopanel.operators import metrics as M
from kronopanel.operators.features import panel_seasonal_index
from kronopanel.plans.inputs import MI, OOF_SQL, PANEL_SQL, Registry, oof, panel, r4, s4
from kronopanel.session import materialize, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

FOLDS = B.make_folds({1: ("2023-12-01", "2024-03-01", "2024-06-01", "2024-09-01"), 3: ("2023-12-01", "2024-03-01", "2024-06-01", "2024-09-01"), 6: ("2023-12-01", "2024-03-01", "2024-06-01"), 12: ("2023-10-01", "2023-11-01", "2023-12-01", "2024-06-01")})
FOLDS_SQL = "folds(fold, cutoff, horizon) AS (VALUES " + ", ".join(f"('{f.name}', DATE '{f.cutoff}', {f.horizon})" for f in FOLDS) + ")"
_ELIGIBLE = "elig AS (SELECT f.fold, p.unique_id, max(p.ds) AS last_train FROM panel p JOIN folds f ON p.ds <= f.cutoff GROUP BY 1, 2 HAVING count(*) >= 6)"
_BASE = f"WITH {PANEL_SQL}, {FOLDS_SQL}, {_ELIGIBLE}"


def _folds(spark: SparkSession) -> DataFrame:
    return B.folds_frame(spark, FOLDS)


@query(_BASE + " SELECT f.fold, p.unique_id, count(*) AS n, round(avg(y), 4) AS mean_y FROM panel p JOIN folds f ON p.ds <= f.cutoff JOIN elig e ON e.fold = f.fold AND e.unique_id = p.unique_id GROUP BY ALL")
def fold_split_train(spark: SparkSession, root: str) -> DataFrame:
    return B.split_train(panel(spark, root), _folds(spark), 6).groupBy("fold", "unique_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y")).select("fold", "unique_id", "n", *r4("mean_y"))


@query(_BASE + " SELECT f.fold, p.unique_id, p.ds, p.y FROM panel p JOIN folds f ON p.ds > f.cutoff AND p.ds <= f.cutoff + to_months(f.horizon) JOIN elig e ON e.fold = f.fold AND e.unique_id = p.unique_id")
def fold_split_test(spark: SparkSession, root: str) -> DataFrame:
    return B.split_test(panel(spark, root), _folds(spark), 6).select("fold", "unique_id", "ds", "y")


@query(_BASE + " SELECT fold, unique_id FROM elig JOIN folds USING (fold) WHERE last_train = cutoff")
def active_series(spark: SparkSession, root: str) -> DataFrame:
    return B.active_series(panel(spark, root), _folds(spark), 6)


@query(f"WITH {PANEL_SQL} SELECT unique_id, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) = {MI.format('max(ds)')} - {MI.format('min(ds)')} + 1")
def regular_series(spark: SparkSession, root: str) -> DataFrame:
    return B.regular_series(panel(spark, root))


@query(_BASE + ", l AS (SELECT max(ds) AS last_ds FROM panel) SELECT fold, (cutoff + to_months(horizon))::DATE AS test_end, last_ds FROM folds, l WHERE cutoff + to_months(horizon) > last_ds")
def fold_coverage(spark: SparkSession, root: str) -> DataFrame:
    return B.coverage_problems(panel(spark, root), _folds(spark))


@query(f"WITH {PANEL_SQL}, m AS (SELECT DISTINCT ds FROM panel WHERE ds <= DATE '2024-06-01'), r AS (SELECT ds, row_number() OVER (ORDER BY ds) AS n FROM m) SELECT ds AS origin FROM r WHERE n >= 7 AND ds + INTERVAL 3 MONTH <= DATE '2024-06-01'")
def training_origins(spark: SparkSession, root: str) -> DataFrame:
    return B.training_origins(panel(spark, root), "2024-06-01", 3, 7)


_FORECAST = _BASE + f""", last AS (SELECT f.fold, p.unique_id, f.cutoff, f.horizon, arg_max(y, ds) AS l, arg_min(y, ds) AS a, {MI.format("max(ds)")} - {MI.format("min(ds)")} AS span, {MI.format("max(ds)")} AS lmi
  FROM panel p JOIN folds f ON p.ds <= f.cutoff JOIN elig e ON e.fold = f.fold AND e.unique_id = p.unique_id GROUP BY ALL),
fc AS (SELECT l.*, (cutoff + to_months(s.step::INT))::DATE AS ds FROM last l, range(1, 13) s(step) WHERE s.step <= l.horizon),
j AS (SELECT fc.*, CASE WHEN p.ds <= fc.cutoff THEN p.y END AS ago FROM fc LEFT JOIN panel p ON p.unique_id = fc.unique_id AND p.ds = (fc.ds - INTERVAL 12 MONTH)::DATE),
fore AS (SELECT fold, unique_id, ds, 'naive' AS model, l AS y_hat FROM j UNION ALL SELECT fold, unique_id, ds, 'seasonal_naive', coalesce(ago, l) FROM j
  UNION ALL SELECT fold, unique_id, ds, 'drift', greatest(0, l + coalesce((l - a) / nullif(span, 0), 0) * ({MI.format("ds")} - lmi)) FROM j),
refoof AS (SELECT t.fold, p.unique_id, p.ds, p.category, t.cutoff, t.horizon, p.y, o.model, o.y_hat, ({MI.format("p.ds")} - {MI.format("t.cutoff")})::INT AS step FROM fore o JOIN folds t USING (fold) JOIN panel p ON p.unique_id = o.unique_id AND p.ds = o.ds)"""


def _reference_oof(spark: SparkSession, root: str) -> DataFrame:
    """Built once and read as often as a query needs it."""
    p, f = panel(spark, root), _folds(spark)
    return materialize(B.build_oof(B.split_test(p, f, 6), B.reference_forecasts(p, f, 6)), "reference-oof")


@query(_FORECAST + " SELECT fold, unique_id, ds, model, step, y, round(y_hat, 4) AS y_hat FROM refoof")
def reference_oof(spark: SparkSession, root: str) -> DataFrame:
    """Naive, seasonal naive and drift forecasts joined to their actuals."""
    return _reference_oof(spark, root).select("fold", "unique_id", "ds", "model", "step", "y", *r4("y_hat"))


@query(_FORECAST + " SELECT model, horizon, category, count(*) AS n, round(avg(abs(y - y_hat)), 4) AS mae FROM refoof GROUP BY ALL")
def reference_mae_by_category(spark: SparkSession, root: str) -> DataFrame:
    return _reference_oof(spark, root).groupBy("model", "horizon", "category").agg(F.count("*").alias("n"), M.mae(F.col("y"), F.col("y_hat")).alias("mae")).select("model", "horizon", "category", "n", *r4("mae"))


@query("""WITH f AS (SELECT fold, unique_id, ds, model, y_hat FROM oof_new), t AS (SELECT DISTINCT fold, unique_id, ds FROM oof_old)
SELECT (SELECT count(*) FROM f WHERE y_hat IS NULL OR isnan(y_hat)) AS no_value, (SELECT count(*) FROM f WHERE y_hat < 0) AS negative, (SELECT count(*) - count(DISTINCT (fold, unique_id, ds, model)) FROM f) AS duplicates,
 (SELECT count(*) FROM f ANTI JOIN t USING (fold, unique_id, ds)) AS outside_test""")
def forecast_contract(spark: SparkSession, root: str) -> DataFrame:
    return B.validate_forecast(table(spark, root, "oof_new"), table(spark, root, "oof_old"))


@query(_FORECAST + """, m AS (SELECT horizon, count(DISTINCT model) AS models FROM refoof GROUP BY 1), k AS (SELECT horizon, unique_id, ds, fold FROM refoof JOIN m USING (horizon) GROUP BY ALL HAVING count(DISTINCT model) = any_value(models))
SELECT horizon, model, count(*) AS n FROM refoof SEMI JOIN k USING (horizon, unique_id, ds, fold) GROUP BY ALL""")
def common_rows(spark: SparkSession, root: str) -> DataFrame:
    return B.common_rows(_reference_oof(spark, root)).groupBy("horizon", "model").agg(F.count("*").alias("n"))


@query(f"WITH {OOF_SQL} SELECT unique_id, ds, model, fold, horizon, y, round(y_hat, 4) AS y_hat FROM oof WHERE horizon <= 3 QUALIFY row_number() OVER (PARTITION BY unique_id, ds, model ORDER BY horizon, cutoff DESC, fold) = 1")
def freshest_forecast(spark: SparkSession, root: str) -> DataFrame:
    return B.freshest_forecast(oof(spark, root), 3).select("unique_id", "ds", "model", "fold", "horizon", "y", *r4("y_hat"))


@query(f"""WITH {OOF_SQL} SELECT model, count(*) AS n, round(avg(abs(y - y_hat)), 4) AS mae, round(sqrt(avg((y - y_hat) * (y - y_hat))), 4) AS rmse, round(sum(abs(y - y_hat)) / nullif(sum(abs(y)), 0), 4) AS wape,
 round(1 - sum((y - y_hat) * (y - y_hat)) / nullif(var_pop(y) * count(y), 0), 4) AS r2 FROM oof GROUP BY 1""")
def metrics_overall(spark: SparkSession, root: str) -> DataFrame:
    y, f = F.col("y"), F.col("y_hat")
    m = oof(spark, root).groupBy("model").agg(F.count("*").alias("n"), M.mae(y, f).alias("mae"), M.rmse(y, f).alias("rmse"), M.wape(y, f).alias("wape"), M.r2(y, f).alias("r2"))
    return m.select("model", "n", *r4("mae", "rmse", "wape", "r2"))


_SUMMARY = f"""WITH {OOF_SQL}, s AS (SELECT model, unique_id, y, y_hat, 'overall' AS slice, 'all' AS value FROM oof UNION ALL SELECT model, unique_id, y, y_hat, 'category', category FROM oof
  UNION ALL SELECT model, unique_id, y, y_hat, 'horizon', horizon::VARCHAR FROM oof UNION ALL SELECT model, unique_id, y, y_hat, 'fold', fold FROM oof),
p AS (SELECT model, slice, value, unique_id, count(*) AS n, sum(abs(y - y_hat)) AS a, sum((y - y_hat) * (y - y_hat)) AS q, sum(abs(y)) AS say, 1 - sum((y - y_hat) * (y - y_hat)) / nullif(var_pop(y) * count(y), 0) AS r2s FROM s WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT model, slice, value, sum(n)::BIGINT AS n, sum(a) / sum(n) AS mae, sqrt(sum(q) / sum(n)) AS rmse, sum(a) / nullif(sum(say), 0) AS wape, avg(a / n) AS mae_macro, median(CASE WHEN n >= 3 THEN r2s END) AS r2_per_series_median FROM p GROUP BY ALL)"""
_METRICS = ("mae", "rmse", "wape", "mae_macro", "r2_per_series_median")


def _summary(spark: SparkSession, root: str) -> DataFrame:
    return M.summarize(oof(spark, root), ["category", "horizon", "fold"])


@query(_SUMMARY + f" SELECT model, slice, value, n, {s4(*_METRICS)} FROM m")
def metrics_by_slice(spark: SparkSession, root: str) -> DataFrame:
    return _summary(spark, root).select("model", "slice", "value", "n", *r4(*_METRICS))


@query(_SUMMARY + f" SELECT model, n, {s4(*_METRICS)}, rank() OVER (ORDER BY m.mae)::INT AS rank FROM m WHERE slice = 'overall'")
def leaderboard(spark: SparkSession, root: str) -> DataFrame:
    return M.leaderboard(_summary(spark, root)).select("model", "n", *r4(*_METRICS), "rank")


_SCALES = f"""WITH {PANEL_SQL}, {OOF_SQL}, p0 AS (SELECT *, count(y) OVER (PARTITION BY unique_id, year(ds)) AS n, avg(y) OVER (PARTITION BY unique_id, year(ds)) AS mean FROM panel),
b AS (SELECT category, month(ds) AS month, median(y / nullif(mean, 0)) AS raw FROM p0 WHERE n = 12 GROUP BY ALL), i AS (SELECT category, month, raw / avg(raw) OVER (PARTITION BY category) AS s FROM b),
p1 AS (SELECT p.unique_id, p.ds, p.y, coalesce(i.s, 1.0) AS s FROM panel p LEFT JOIN i ON i.category = p.category AND i.month = month(p.ds)),
p2 AS (SELECT *, lag(y) OVER w AS py, lag(s) OVER w AS ps, lag(ds) OVER w AS pds FROM p1 WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
scales AS (SELECT unique_id, avg(CASE WHEN (pds + INTERVAL 1 MONTH)::DATE = ds THEN abs(y - py * s / nullif(ps, 0)) END) AS mase_scale FROM p2 GROUP BY 1)"""


@query(_SCALES + " SELECT unique_id, round(mase_scale, 4) AS mase_scale FROM scales")
def mase_scale(spark: SparkSession, root: str) -> DataFrame:
    p = panel(spark, root)
    return M.mase_scales(p, panel_seasonal_index(p)).select("unique_id", *r4("mase_scale"))


@query(_FORECAST + "," + _SCALES.removeprefix(f"WITH {PANEL_SQL}, ") + ", r AS (SELECT o.model, o.unique_id, avg(abs(o.y - o.y_hat) / s.mase_scale) AS r FROM refoof o JOIN scales s USING (unique_id) WHERE s.mase_scale > 0 GROUP BY 1, 2) SELECT model, round(avg(r), 4) AS mase FROM r GROUP BY 1")
def mase_by_model(spark: SparkSession, root: str) -> DataFrame:
    p = panel(spark, root)
    return M.mase(_reference_oof(spark, root), M.mase_scales(p, panel_seasonal_index(p))).select("model", *r4("mase"))


@query(f"""WITH {OOF_SQL}, q AS (SELECT *, CASE WHEN model <> 'theta' OR horizon <> 6 THEN y_hat * 0.9 END AS q10, y_hat * 1.1 AS q90 FROM oof)
SELECT model, horizon, CASE WHEN count(q10) = count(*) THEN round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 4) END AS pinball_10, round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 4) AS pinball_90,
 CASE WHEN count(q10) = count(*) THEN round(avg((y >= q10 AND y <= q90)::INT), 4) END AS coverage FROM q GROUP BY ALL""")
def pinball_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Quantile metrics, undefined where a slice lacks some quantile."""
    q = oof(spark, root).withColumn("q10", F.when((F.col("model") != "theta") | (F.col("horizon") != 6), F.col("y_hat") * 0.9)).withColumn("q90", F.col("y_hat") * 1.1)
    y, lo, hi = F.col("y"), F.col("q10"), F.col("q90")
    m = q.groupBy("model", "horizon").agg(M.full_only(M.pinball(y, lo, 0.1), "q10").alias("pinball_10"), M.pinball(y, hi, 0.9).alias("pinball_90"), M.full_only(M.coverage(y, lo, hi), "q10", "q90").alias("coverage"))
    return m.select("model", "horizon", *r4("pinball_10", "pinball_90", "coverage"))


@query(f"WITH {OOF_SQL} SELECT model, " + ", ".join(f"round(avg(abs(y - y_hat)) FILTER (horizon = {h}), 4) AS h{h}" for h in (1, 3, 6)) + " FROM oof GROUP BY 1")
def horizon_leaderboard(spark: SparkSession, root: str) -> DataFrame:
    return M.horizon_table(oof(spark, root), (1, 3, 6)).select("model", *r4("h1", "h3", "h6"))


@query(f"""WITH {OOF_SQL}, m AS (SELECT horizon, model, avg(abs(y - y_hat)) AS mae FROM oof GROUP BY ALL)
SELECT horizon, arg_min(model, (mae, model)) AS winner, round(min(mae), 4) AS mae, round(min(mae) - min(mae) FILTER (model = 'seasonal_naive'), 4) AS gain FROM m GROUP BY 1""")
def horizon_winners(spark: SparkSession, root: str) -> DataFrame:
    return M.horizon_winners(oof(spark, root), "seasonal_naive").select("horizon", "winner", *r4("mae", "gain"))


_PAIRS = _FORECAST + ", d AS (SELECT a.unique_id, a.ds, a.fold, abs(a.y - a.y_hat) - abs(b.y - b.y_hat) AS d FROM refoof a JOIN refoof b ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.fold = b.fold WHERE a.model = 'seasonal_naive' AND b.model = 'naive')"


@query(_PAIRS + " SELECT unique_id, round(avg(d), 4) AS d, count(*) AS n FROM d GROUP BY 1")
def panel_dm_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Per series mean loss difference of two models: the sample of the panel test."""
    return M.loss_differences(_reference_oof(spark, root), "seasonal_naive", "naive").groupBy("unique_id").agg(F.avg("d").alias("d"), F.count("*").alias("n")).select("unique_id", *r4("d"), "n")


@query(_PAIRS + ", f AS (SELECT fold, avg(d) AS d FROM d GROUP BY 1) SELECT count(*) AS folds, count(*) FILTER (d < 0) AS better, count(*) FILTER (d > 0) AS worse, round(avg(d), 4) AS mean_of_folds FROM f")
def fold_consistency(spark: SparkSession, root: str) -> DataFrame:
    return M.fold_consistency(_reference_oof(spark, root), "seasonal_naive", "naive").select("folds", "better", "worse", *r4("mean_of_folds"))


@query(_FORECAST + """, e AS (SELECT unique_id, model, round(avg(abs(y - y_hat)), 6) AS err FROM refoof GROUP BY ALL), k AS (SELECT count(DISTINCT model) AS k FROM e), c AS (SELECT *, count(*) OVER (PARTITION BY unique_id) AS n FROM e),
r AS (SELECT model, rank() OVER (PARTITION BY unique_id ORDER BY err) + (count(*) OVER (PARTITION BY unique_id, err) - 1) / 2.0 AS rk FROM c, k WHERE n = k) SELECT model, round(avg(rk), 4) AS mean_rank, count(*) AS blocks FROM r GROUP BY 1""")
def model_ranks(spark: SparkSession, root: str) -> DataFrame:
    e = _reference_oof(spark, root).groupBy("unique_id", "model").agg(F.round(M.mae(F.col("y"), F.col("y_hat")), 6).alias("err"))
    return M.rank_models(e, "unique_id").select("model", *r4("mean_rank"), "blocks")


_RUNS = """WITH a AS (SELECT DISTINCT * FROM oof_old WHERE y IS NOT NULL AND y_hat IS NOT NULL AND NOT isnan(y) AND NOT isnan(y_hat)), b AS (SELECT DISTINCT * FROM oof_new WHERE y_hat IS NOT NULL AND NOT isnan(y_hat)),
c AS (SELECT a.model, a.horizon, count(*) AS n, avg(abs(a.y - a.y_hat)) AS mae_old, avg(abs(a.y - b.y_hat)) AS mae_new, count(*) FILTER (abs(a.y_hat - b.y_hat) > 1e-6) AS differing FROM a JOIN b ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.fold = b.fold AND a.model = b.model GROUP BY ALL)"""


def _runs(spark: SparkSession, root: str) -> DataFrame:
    new = table(spark, root, "oof_new").where("y_hat is not null and not isnan(y_hat)").dropDuplicates()
    return M.compare_runs(oof(spark, root), new)


@query(_RUNS + " SELECT model, horizon, n, round(mae_old, 4) AS mae_old, round(mae_new, 4) AS mae_new, differing FROM c")
def compare_runs(spark: SparkSession, root: str) -> DataFrame:
    return _runs(spark, root).select("model", "horizon", "n", *r4("mae_old", "mae_new"), "differing")


@query(_RUNS + ", v AS (SELECT model, sum(n)::BIGINT AS n, sum(differing)::BIGINT AS differing, max(abs(mae_old - mae_new)) AS shift FROM c GROUP BY 1) SELECT model, n, differing, round(shift, 4) AS shift, CASE WHEN differing = 0 THEN 'identical' WHEN shift <= 0.01 THEN 'numeric' ELSE 'changed' END AS verdict FROM v")
def run_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return M.run_verdicts(_runs(spark, root)).select("model", "n", "differing", *r4("shift"), "verdict")


@query(_FORECAST + ", t AS (SELECT model, avg(abs(y - y_hat)) AS mae FROM refoof GROUP BY 1) SELECT model, round(mae, 4) AS mae, round(mae - (SELECT mae FROM t WHERE model = 'naive'), 4) AS delta FROM t")
def ablation_delta(spark: SparkSession, root: str) -> DataFrame:
    t = _reference_oof(spark, root).groupBy("model").agg(M.mae(F.col("y"), F.col("y_hat")).alias("mae"))
    return M.contributions(t, "naive").select("model", *r4("mae", "delta"))


@query(_PAIRS + ", h AS (SELECT split_part(fold, '_', 1) AS h, fold, d FROM d) SELECT h, count(DISTINCT fold) AS folds, count(*) AS n, round(avg(d), 4) AS delta FROM h GROUP BY 1")
def source_contribution(spark: SparkSession, root: str) -> DataFrame:
    d = M.loss_differences(_reference_oof(spark, root), "seasonal_naive", "naive").withColumn("h", F.split_part("fold", F.lit("_"), F.lit(1)))
    return d.groupBy("h").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n"), F.avg("d").alias("delta")).select("h", "folds", "n", *r4("delta"))


@query(f"WITH {OOF_SQL}, k AS (SELECT unique_id, ds, fold FROM oof WHERE model IN ('ets', 'seasonal_naive') GROUP BY ALL HAVING count(DISTINCT model) = 2) SELECT model, count(*) AS n FROM oof SEMI JOIN k USING (unique_id, ds, fold) WHERE model IN ('ets', 'seasonal_naive') GROUP BY 1")
def rows_common_to_two(spark: SparkSession, root: str) -> DataFrame:
    return B.common_to(oof(spark, root), ["ets", "seasonal_naive"]).groupBy("model").agg(F.count("*").alias("n"))


@query(_FORECAST + " SELECT fold, unique_id, ds, round(max(y_hat) FILTER (model = 'naive'), 4) AS naive, round(max(y_hat) FILTER (model = 'drift'), 4) AS drift FROM refoof GROUP BY ALL")
def pivot_predictions(spark: SparkSession, root: str) -> DataFrame:
    w = _reference_oof(spark, root).groupBy("fold", "unique_id", "ds").pivot("model", ["naive", "drift"]).agg(F.max("y_hat"))
    return w.select("fold", "unique_id", "ds", *r4("naive", "drift"))


@query(f"WITH {OOF_SQL} SELECT unique_id, ds, fold, model, what, amount FROM (SELECT unique_id, ds, fold, model, round(y, 4) AS y, round(y_hat, 4) AS y_hat FROM oof) UNPIVOT (amount FOR what IN (y, y_hat))")
def unpivot_forecasts(spark: SparkSession, root: str) -> DataFrame:
    """Actuals and forecasts in one column, all horizons."""
    return oof(spark, root).select("unique_id", "ds", "fold", "model", *r4("y", "y_hat")).unpivot(["unique_id", "ds", "fold", "model"], ["y", "y_hat"], "what", "amount")


@query(f"WITH {PANEL_SQL}, b AS (SELECT category, count(DISTINCT unique_id) AS size FROM panel GROUP BY 1), q AS (SELECT category, size, size * 50.0 / sum(size) OVER () AS x FROM b) SELECT category, size, round_even(x, 0)::BIGINT AS take FROM q")
def stratified_counts(spark: SparkSession, root: str) -> DataFrame:
    return B.stratified_counts(panel(spark, root), "category", 50)


def stratified_series(spark: SparkSession, root: str) -> DataFrame:
    """A reproducible stratified draw of series (the hash differs between engines: no SQL twin)."""
    return B.stratified_sample(panel(spark, root), "category", 50, 7)


query()(stratified_series)


@query(f"WITH {OOF_SQL}, e AS (SELECT unique_id, category, max(abs(y - y_hat)) AS worst, arg_max(ds, (abs(y - y_hat), ds)) AS ds FROM oof GROUP BY ALL) SELECT category, unique_id, ds, round(worst, 4) AS worst, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY worst DESC, unique_id)::INT AS rank FROM e) WHERE rank <= 3")
def worst_residuals(spark: SparkSession, root: str) -> DataFrame:
    """The three series of each category with the largest single error, and its month."""
    from pyspark.sql import Window

    e = F.abs(F.col("y") - F.col("y_hat"))
    s = oof(spark, root).groupBy("unique_id", "category").agg(F.max(e).alias("worst"), F.max_by("ds", F.struct(e, "ds")).alias("ds"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("worst"), "unique_id"))
    return s.withColumn("rank", rank).where("rank <= 3").select("category", "unique_id", "ds", *r4("worst"), "rank")


@query("SELECT (SELECT count(*) FROM (SELECT unique_id, ds, fold, model, horizon FROM oof_old EXCEPT ALL SELECT unique_id, ds, fold, model, horizon FROM oof_new)) AS only_old, (SELECT count(*) FROM (SELECT unique_id, ds, fold, model, horizon FROM oof_new EXCEPT ALL SELECT unique_id, ds, fold, model, horizon FROM oof_old)) AS only_new, (SELECT count(*) FROM (SELECT unique_id, ds, fold, model, horizon FROM oof_new INTERSECT SELECT unique_id, ds, fold, model, horizon FROM oof_old)) AS shared")
def multiset_difference(spark: SparkSession, root: str) -> DataFrame:
    """Multiset equality of two exports: rows only in one, distinct rows in both."""
    cols = ["unique_id", "ds", "fold", "model", "horizon"]
    a, b = table(spark, root, "oof_old").select(*cols), table(spark, root, "oof_new").select(*cols)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.exceptAll(b), "only_old").crossJoin(count(b.exceptAll(a), "only_new")).crossJoin(count(a.intersect(b), "shared"))


# -- slices with pooled R2, scaled errors and quantiles; tests between models --------------------------

_PARTS = "".join(f" UNION ALL SELECT model, unique_id, y, y_hat, q10, q90, mase_scale, '{c}', {c}::VARCHAR FROM o" for c in ("category", "step", "horizon", "fold"))
_SLICED = _FORECAST + "," + _SCALES.removeprefix(f"WITH {PANEL_SQL}, ").removeprefix(OOF_SQL + ", ") + f""", o AS (SELECT r.*, CASE WHEN model <> 'drift' OR step <> 2 THEN y_hat * 0.9 END AS q10, y_hat * 1.1 AS q90, CASE WHEN s.mase_scale > 0 THEN s.mase_scale END AS mase_scale FROM refoof r LEFT JOIN scales s USING (unique_id)),
sl AS (SELECT model, unique_id, y, y_hat, q10, q90, mase_scale, 'overall' AS slice, 'all' AS value FROM o{_PARTS}),
per AS (SELECT model, slice, value, unique_id, count(*) AS n, sum(abs(y - y_hat)) AS a, max(mase_scale) AS sc FROM sl GROUP BY ALL), m AS (SELECT model, slice, value, avg(a / n / sc) AS mase FROM per GROUP BY ALL),
g AS (SELECT model, slice, value, count(*) AS n, 1 - sum((y - y_hat) * (y - y_hat)) / nullif(var_pop(y) * count(*), 0) AS r2_pooled, CASE WHEN count(q10) = count(*) THEN avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))) END AS pinball_10,
  avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))) AS pinball_90, CASE WHEN count(q10) = count(*) THEN avg((y >= q10 AND y <= q90)::INT) END AS coverage FROM sl GROUP BY ALL)
SELECT model, slice, value, n, {s4("r2_pooled", "mase", "pinball_10", "pinball_90", "coverage")} FROM g JOIN m USING (model, slice, value)"""


@query(_SLICED)
def metric_slices(spark: SparkSession, root: str) -> DataFrame:
    """Pooled R2, scaled error, pinball and coverage of the reference forecasts, overall and by slice."""
    p = panel(spark, root)
    o = _reference_oof(spark, root).withColumn("q_0.1", F.when((F.col("model") != "drift") | (F.col("step") != 2), F.col("y_hat") * 0.9)).withColumn("q_0.9", F.col("y_hat") * 1.1)
    out = M.metric_slices(o, ["category", "step", "horizon", "fold"], scales=M.mase_scales(p, panel_seasonal_index(p)), levels=(0.1, 0.9))
    return out.select("model", "slice", "value", "n", *r4("r2_pooled", "mase", "pinball_10", "pinball_90", "coverage"))


_DM_PAIRS = (("seasonal_naive", "naive"), ("drift", "naive"), ("drift", "seasonal_naive"))


@query(_FORECAST + ", d AS (" + " UNION ALL ".join(f"SELECT a.horizon, '{x}' AS a, '{z}' AS b, a.unique_id, avg(abs(a.y - a.y_hat) - abs(b.y - b.y_hat)) AS d FROM refoof a JOIN refoof b USING (unique_id, ds, fold, horizon) WHERE a.model = '{x}' AND b.model = '{z}' GROUP BY ALL" for x, z in _DM_PAIRS) + """)
SELECT horizon, a, b, count(*) AS n, round(avg(d), 4) AS mean, round(CASE WHEN count(*) >= 3 AND var_pop(d) > 0 THEN avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)) END, 4) AS stat FROM d GROUP BY ALL""")
def dm_tests(spark: SparkSession, root: str) -> DataFrame:
    """Paired tests between the reference models at each horizon, series by series."""
    return M.panel_dm(_reference_oof(spark, root), _DM_PAIRS).select("horizon", "a", "b", "n", *r4("mean", "stat"))


@query()
def dm_p_values(spark: SparkSession, root: str) -> DataFrame:
    """The same with two-sided p values of Student's t (no SQL twin: its distribution)."""
    rows = M.panel_dm(_reference_oof(spark, root), _DM_PAIRS).collect()  # horizons x pairs
    return spark.createDataFrame([(r.horizon, r.a, r.b, r.stat, None if r.stat is None else M.student_tail(r.stat, r.n - 1)) for r in rows], "horizon int, a string, b string, stat double, p double").select("horizon", "a", "b", *r4("stat", "p"))


@query()
def friedman_test(spark: SparkSession, root: str) -> DataFrame:
    """Whether the models' mean ranks over series differ, and by how much two must (no SQL twin: distributions)."""
    e = _reference_oof(spark, root).groupBy("unique_id", "model").agg(F.round(M.mae(F.col("y"), F.col("y_hat")), 6).alias("err"))
    ranks = M.rank_models(e, "unique_id").collect()  # a row per model
    if len(ranks) < 3:
        return spark.createDataFrame([], "models int, blocks long, statistic double, p double, critical_difference double")
    n = ranks[0].blocks
    stat, p = M.friedman([r.mean_rank for r in ranks], n)
    return spark.createDataFrame([(len(ranks), n, stat, p, M.nemenyi_difference(len(ranks), n))], "models int, blocks long, statistic double, p double, critical_difference double").select("models", "blocks", *r4("statistic", "p", "critical_difference"))


@query(f"WITH {OOF_SQL}, p AS (SELECT horizon, model, count(*) AS n FROM oof GROUP BY ALL) SELECT horizon, count(*) AS models, max(n) AS observations FROM p GROUP BY 1")
def horizon_coverage(spark: SparkSession, root: str) -> DataFrame:
    return M.horizon_coverage(oof(spark, root))


_RUN_MAE = "SELECT horizon, model, avg(abs(y - y_hat)) AS mae FROM (SELECT DISTINCT * FROM {0} WHERE y IS NOT NULL AND y_hat IS NOT NULL AND NOT isnan(y) AND NOT isnan(y_hat)) GROUP BY ALL"
_LEAD = "SELECT horizon, arg_min(model, (mae, model)) AS leader_{0}, min(mae) AS mae_{0}, min(mae) FILTER (model = 'ets') AS reference_{0} FROM {0}m GROUP BY 1"


@query(f"""WITH oldm AS ({_RUN_MAE.format("oof_old")}), newm AS ({_RUN_MAE.format("oof_new")}), a AS ({_LEAD.format("old")}), b AS ({_LEAD.format("new")})
SELECT horizon, leader_old, round(mae_old, 4) AS mae_old, round(reference_old, 4) AS reference_old, leader_new, round(mae_new, 4) AS mae_new, round(reference_new, 4) AS reference_new, leader_old IS DISTINCT FROM leader_new AS leader_changed FROM a FULL JOIN b USING (horizon)""")
def horizon_leaders(spark: SparkSession, root: str) -> DataFrame:
    """Who leads each horizon in either run."""
    run = lambda name: table(spark, root, name).where("y is not null and y_hat is not null and not isnan(y) and not isnan(y_hat)").dropDuplicates()
    out = M.horizon_leaders(run("oof_old"), run("oof_new"), "ets")
    return out.select("horizon", "leader_old", *r4("mae_old", "reference_old"), "leader_new", *r4("mae_new", "reference_new"), "leader_changed")
