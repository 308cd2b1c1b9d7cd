"""Queries on models, ensembles and streams.  Learned or iterative results have no SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators import backtest as B
from kronopanel.operators import changepoint as C
from kronopanel.operators import models as L
from kronopanel.operators.metrics import mae
from kronopanel.plans.changepoint_queries import _labels, _stream
from kronopanel.plans.inputs import OOF_SQL, Registry, oof, panel, r4
from kronopanel.session import materialize, shared_dir, table
from kronopanel.streaming import detectors as S

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_FOLDS = B.make_folds({3: ("2024-03-01", "2024-06-01", "2024-09-01")})


@query()
def local_models(spark: SparkSession, root: str) -> DataFrame:
    """Error of the local models over three windows."""
    p, f = panel(spark, root), B.folds_frame(spark, _FOLDS)
    test = materialize(B.split_test(p, f, 6), "test")
    out = None
    for name in ("ets", "theta", "ar", "trend_season"):
        part = B.build_oof(test, L.get(name)(p, f))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model", "step").agg(F.count("*").alias("n"), mae(F.col("y"), F.col("y_hat")).alias("mae")).select("model", "step", "n", *r4("mae"))


@query()
def gbt_forecast(spark: SparkSession, root: str) -> DataFrame:
    p = materialize(panel(spark, root), "panel")
    fold = _FOLDS[-1]
    fc = L.get("gbt")(p, (fold.name, fold.cutoff, fold.horizon))
    test = B.split_test(p, B.folds_frame(spark, [fold]), 6)
    return B.build_oof(test, fc).select("unique_id", "ds", "step", "y", *r4("y_hat"))


@query()
def ensemble_weights(spark: SparkSession, root: str) -> DataFrame:
    """Weights by category from forecasts whose target month was known at the cutoff."""
    o = B.common_to(_reference(spark, root), ["naive", "seasonal_naive", "drift"])
    return L.weights_as_of(o, "2024-09-01", ["naive", "seasonal_naive", "drift"], "category").select("category", "model", *r4("weight"))


def _reference(spark: SparkSession, root: str) -> DataFrame:
    p, f = panel(spark, root), B.folds_frame(spark, B.make_folds({3: ("2024-03-01", "2024-06-01", "2024-09-01")}))
    return materialize(B.build_oof(B.split_test(p, f, 6), B.reference_forecasts(p, f, 6)), "reference")


@query()
def ensemble_forecast(spark: SparkSession, root: str) -> DataFrame:
    o = _reference(spark, root)
    history = o.where("ds <= date'2024-09-01'")
    levels = (0.1, 0.5, 0.9)
    q = L.with_quantiles(o, L.residual_quantiles(history, levels), levels)
    w = L.weights_as_of(history, "2024-09-01", ["naive", "seasonal_naive", "drift"]).drop("group")
    out = L.combine(q.where("cutoff = date'2024-09-01'"), w)
    return out.select("unique_id", "ds", "fold", "model", *r4("y", "y_hat"), F.round("`q_0.1`", 4).alias("q_10"), F.round("`q_0.9`", 4).alias("q_90"))


@query(f"WITH {OOF_SQL} SELECT model, horizon, " + ", ".join(f"round(quantile_cont((y - y_hat) / nullif(y_hat, 0), {q}), 4) AS r_{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM oof GROUP BY ALL")
def residual_quantiles(spark: SparkSession, root: str) -> DataFrame:
    q = L.residual_quantiles(oof(spark, root), (0.1, 0.5, 0.9))
    return q.select("model", "horizon", F.col("`r_0.1`").alias("r_10"), F.col("`r_0.5`").alias("r_50"), F.col("`r_0.9`").alias("r_90")).select("model", "horizon", *r4("r_10", "r_50", "r_90"))


@query()
def hazard_model(spark: SparkSession, root: str) -> DataFrame:
    """Probability of a break within two months for held-out series, with the best alarm threshold."""
    stream = materialize(_stream(spark, root).select("unique_id", F.col("t").cast("long").alias("t"), "z"), "stream")
    labels = C.hazard_labels(stream.select("unique_id", "t"), _labels(spark, root).select("unique_id", F.col("tau").cast("long").alias("tau")))
    rows = C.residual_trajectory(stream).join(labels, ["unique_id", "t"])
    features = ["z", "resid_mean_3", "resid_absmean_3", "resid_std_3", "resid_mean_6", "resid_absmean_6", "resid_trend", "resid_sign_run"]
    scored = materialize(L.hazard_probabilities(materialize(rows, "hazard"), "z_h2", features), "scored")
    cut = L.best_threshold(scored)
    return scored.crossJoin(F.broadcast(cut)).select("unique_id", "t", "label", *r4("p"), (F.col("p") >= F.col("threshold")).alias("alarm"))


_ENSEMBLE = ("naive", "seasonal_naive", "drift")


def _pool(spark: SparkSession, root: str) -> DataFrame:
    from kronopanel.plans.backtest_queries import _reference_oof

    return _reference_oof(spark, root)


@query()
def rolling_weights(spark: SparkSession, root: str) -> DataFrame:
    """Least-absolute-error weights of every fold of every horizon, from what was known at its cutoff (iterative: no SQL twin)."""
    return L.rolling_origin_weights(_pool(spark, root), _ENSEMBLE).select("horizon", "fold", "model", *r4("weight"))


@query()
def rolling_ensemble(spark: SparkSession, root: str) -> DataFrame:
    """Error of the rolling-origin ensembles, pooled and by category, beside their models, at each horizon."""
    o = materialize(_pool(spark, root), "pool")
    q = L.with_quantiles(o, L.residual_quantiles(o.where("ds <= date'2024-03-01'"), (0.1, 0.5, 0.9)), (0.1, 0.5, 0.9))
    cols = ["model", "horizon", "unique_id", "ds", "fold", "y", "y_hat", "step", "category", "cutoff"]
    both = [L.rolling_origin_ensemble(q, _ENSEMBLE).select(*cols), L.rolling_origin_ensemble(o, _ENSEMBLE, by="category", name="ensemble by category").select(*cols)]
    rows = o.select(*cols).unionByName(both[0]).unionByName(both[1])
    return rows.groupBy("model", "horizon").agg(F.count("*").alias("n"), mae(F.col("y"), F.col("y_hat")).alias("mae")).select("model", "horizon", "n", *r4("mae"))


def _replayed(spark: SparkSession, root: str, what: str) -> DataFrame:
    """The batch stream written as files, read back as a stream, and run to its end."""
    x = _stream(spark, root).select("unique_id", F.col("ds").cast("timestamp").alias("ts"), F.round(F.coalesce("z", F.lit(0.0)), 6).alias("x"))
    # one late row moves the watermark past the last month, so that held rows are released
    end = spark.range(1).select(F.lit("~end").alias("unique_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("x"))
    place = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    x.unionByName(end).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(x.schema).parquet(f"{place}/in")
    q = S.stream_alarms(stream).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("unique_id string, ts timestamp, kind string, statistic double").parquet(f"{place}/out").where(F.col("kind") == what).select("unique_id", F.to_date("ts").alias("ds"))


def _stream_twin(name: str) -> str:
    from kronopanel.plans.changepoint_queries import ORACLE as twins

    return f"SELECT a.unique_id, p.ds FROM ({twins[name]}) a JOIN (SELECT territory_id::VARCHAR || '__' || category AS unique_id, (date || '-01')::DATE AS ds, row_number() OVER (PARTITION BY territory_id, category ORDER BY date) - 1 AS t FROM (SELECT DISTINCT territory_id, category, date FROM consumption WHERE value IS NOT NULL AND territory_id IS NOT NULL)) p ON p.unique_id = a.unique_id AND p.t = a.t"


@query(_stream_twin("cusum_alarms"))
def stream_cusum(spark: SparkSession, root: str) -> DataFrame:
    """CUSUM alarms of the replayed stream: those of the batch operator."""
    return _replayed(spark, root, "cusum")


@query(_stream_twin("page_hinkley_alarms"))
def stream_page_hinkley(spark: SparkSession, root: str) -> DataFrame:
    return _replayed(spark, root, "page_hinkley")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, root: str) -> DataFrame:
    """Daily counts by the windowed aggregate that also runs on streams."""
    return S.windowed_counts(table(spark, root, "events")).select("start", "event_type", "n", *r4("mean"))


# -- ablations and tuning -----------------------------------------------------------------------------


def _exogenous(spark: SparkSession, root: str):  # noqa: ANN202
    """Adds calendar, seasonal and national columns to (origin, ds) rows."""
    from kronopanel.operators import national as N
    from kronopanel.operators.features import panel_seasonal_index
    from kronopanel.plans.panel_queries import INDICATORS, _indicators

    keep = [s for s in INDICATORS if s.prefix in ("infl", "key_rate", "wages", "business", "payroll")]
    groups = N.national_groups(_indicators(spark, root).where(F.col("source").isin(*[s.slug for s in keep])))
    origins = panel(spark, root).select(F.col("ds").alias("origin")).distinct()
    known = materialize(N.national_as_of(groups, origins), "national")
    names = sorted(c for c in known.columns if c != "origin")
    # the index of a category may only use what every window knew at its cutoff
    index = materialize(panel_seasonal_index(panel(spark, root).where("ds <= date'2023-12-01'")), "seasonal")

    def add(rows: DataFrame) -> DataFrame:
        return N.covariates(rows, index).join(F.broadcast(known), "origin", "left")  # a row per month

    return add, {"own": ["lag_1", "lag_2", "lag_3", "roll_mean_3", "roll_std_3", "roll_mean_6"], "calendar": ["month_sin", "month_cos", "seasonal_index"], "macro": names}


def _ablation(spark: SparkSession, root: str) -> DataFrame:
    from kronopanel.operators import ablation as A
    from kronopanel.operators.national import feature_sets

    add, blocks = _exogenous(spark, root)
    variants = feature_sets(blocks, {"A": ["own"], "B": ["own", "calendar"], "C": ["own", "calendar", "macro"]})
    return materialize(A.ablation_forecasts(panel(spark, root), [(f.name, f.cutoff, f.horizon) for f in _FOLDS], variants, add), "ablation")


@query()
def ablation_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Own history, with calendar, with national indicators: error of the same linear model on common rows (fitted: no SQL twin)."""
    from kronopanel.operators import ablation as A

    return A.ablation_matrix(_ablation(spark, root), "A").select("model", "n", *r4("mae", "delta"))


@query()
def block_contributions(spark: SparkSession, root: str) -> DataFrame:
    """What each block adds, with the paired test over series and the sign test over windows (fitted: no SQL twin)."""
    from kronopanel.operators import ablation as A

    out = A.block_contributions(_ablation(spark, root), [("B", "A"), ("C", "B")])
    return out.select("with_block", "base", "n", *r4("mae_with", "mae_base", "stat", "p"), "folds", "better", "worse", *r4("sign_p"))


@query()
def tuned_boosting(spark: SparkSession, root: str) -> DataFrame:
    """Boosted trees over a grid, judged on the months before the cutoff (learned: no SQL twin)."""
    from kronopanel.operators import ablation as A

    grid = [{"trees": t, "depth": d} for t in (5, 10) for d in (2, 4)]
    return A.tune(panel(spark, root), "2024-06-01", 3, grid, L.get("gbt")).select("candidate", "parameters", *r4("mae"), "chosen")
