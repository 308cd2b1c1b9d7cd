"""What feature blocks are worth: the same model with and without them, on the same observations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronopanel.operators.backtest import common_to
from kronopanel.operators.features import direct_rows, forecast_from_ratio, lag_features
from kronopanel.operators.metrics import panel_dm, sign_test, student_tail
from kronopanel.session import materialize

#: Columns every variant has: the step ahead.
ALWAYS = ("step",)


def _vectors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    clean = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    x = rows.select("*", *[clean(c).alias(f"x{i}") for i, c in enumerate(columns)])
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(x).drop(*[f"x{i}" for i in range(len(columns))])


def ablation_forecasts(panel: DataFrame, folds: Sequence[tuple[str, str, int]], variants: Mapping[str, Sequence[str]], blocks: Callable[[DataFrame], DataFrame], ridge: float = 1e-3) -> DataFrame:
    """Out-of-fold forecasts of every variant: a linear direct model on its columns, per fold, trained on known targets.

    ``blocks`` adds the exogenous columns to (unique_id, origin, ds) rows; they are joined once a fold and shared by the
    variants.  A missing feature counts as 0.
    """
    from pyspark.ml.regression import LinearRegression

    actual = panel.select("unique_id", "ds", "y", "category")
    out = None
    for name, cutoff, horizon in folds:
        until = F.lit(cutoff).cast("date")
        known = panel.where(F.col("ds") <= until)
        train = materialize(blocks(direct_rows(known, horizon)), "ablation-train")
        now = lag_features(known).where(F.col("origin") == until).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.add_months("origin", F.col("step")))
        test = materialize(blocks(now.join(actual, ["unique_id", "ds"])), "ablation-test")
        for variant, columns in variants.items():
            cols = [*ALWAYS, *columns]
            model = LinearRegression(regParam=ridge, solver="normal").fit(_vectors(train, cols).select("features", F.col("target").alias("label")))
            p = model.transform(_vectors(test, cols)).select(
                "unique_id", "ds", F.lit(name).alias("fold"), until.alias("cutoff"), F.lit(horizon).alias("horizon"), "category", F.lit(variant).alias("model"), "y", forecast_from_ratio(F.col("y_last"), F.col("prediction")).alias("y_hat")
            )
            out = p if out is None else out.unionByName(p)
    return out


def ablation_matrix(oof: DataFrame, baseline: str) -> DataFrame:
    """Error of each variant on the observations all of them predicted, and its difference to the baseline's."""
    names = [r.model for r in oof.select("model").distinct().collect()]  # the variants
    if baseline not in names:
        raise KeyError(f"no baseline {baseline}")
    m = common_to(oof, names).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"))
    base = m.where(F.col("model") == baseline).select(F.col("mae").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("model", "n", "mae", (F.col("mae") - F.col("base")).alias("delta"))  # one row


def block_contributions(oof: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``with, base`` pairs on common observations: errors, paired test over series, windows won and their sign test."""
    spark, rows = oof.sparkSession, []
    every = oof.withColumn("horizon", F.lit(0))  # the test pools the horizons
    for a, b in pairs:
        shared = common_to(every, [a, b])
        test = panel_dm(shared, [(a, b)]).first()
        e = F.abs(F.col("y") - F.col("y_hat"))
        per = shared.groupBy("fold").agg(F.avg(F.when(F.col("model") == a, e)).alias("ea"), F.avg(F.when(F.col("model") == b, e)).alias("eb"), F.count_if(F.col("model") == a).alias("n")).collect()  # the windows
        n = sum(r.n for r in per)
        total = lambda c: sum(r[c] * r.n for r in per) / n if n else None  # noqa: B023, E731
        better, worse = sum(r.ea < r.eb for r in per), sum(r.ea > r.eb for r in per)
        stat = test.stat if test else None
        rows.append((a, b, n, total("ea"), total("eb"), stat, None if stat is None else student_tail(stat, test.n - 1), len(per), better, worse, sign_test(better, worse)))
    return spark.createDataFrame(rows, "with_block string, base string, n long, mae_with double, mae_base double, stat double, p double, folds int, better int, worse int, sign_p double")


def tune(panel: DataFrame, cutoff: str, horizon: int, grid: Sequence[Mapping[str, int]], model: Callable[..., DataFrame]) -> DataFrame:
    """Error of each parameter set on the ``horizon`` months before the cutoff, none of which it was trained on; the first best is chosen."""
    spark = panel.sparkSession
    known = materialize(panel.where(F.col("ds") <= F.lit(cutoff).cast("date")), "tuning")
    start = known.select(F.add_months(F.lit(cutoff).cast("date"), -horizon).cast("string")).first()[0]
    rows = []
    for i, parameters in enumerate(grid):
        fc = model(known, ("validation", start, horizon), **parameters)
        mae = fc.join(known.select("unique_id", "ds", "y"), ["unique_id", "ds"]).agg(F.avg(F.abs(F.col("y") - F.col("y_hat")))).first()[0]
        rows.append((i, ", ".join(f"{k}={v}" for k, v in parameters.items()), mae))
    known_rows = [r for r in rows if r[2] is not None]
    best = min(known_rows, key=lambda r: (r[2], r[0]))[0] if known_rows else -1
    return spark.createDataFrame([(i, p, m, i == best) for i, p, m in rows], "candidate int, parameters string, mae double, chosen boolean")
