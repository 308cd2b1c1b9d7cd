"""Forecast metrics, leaderboards and paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((y - f) * (y - f)))


def wape(y: Column, f: Column) -> Column:
    return F.try_divide(F.sum(F.abs(y - f)), F.sum(F.abs(y)))


def r2(y: Column, f: Column) -> Column:
    """NULL where the actuals do not vary."""
    return F.lit(1.0) - F.try_divide(F.sum((y - f) * (y - f)), F.var_pop(y) * F.count(y))


def pinball(y: Column, q: Column, level: float) -> Column:
    d = y - q
    return F.avg(F.greatest(level * d, (level - 1) * d))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("int"))


def full_only(metric: Column, *cols: str) -> Column:
    """The metric, if none of its quantile columns is NULL anywhere in the slice."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.count(c) == F.count(F.lit(1)))
    return F.when(ok, metric)


def summarize(oof: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Metrics overall and per value of each slice, in one pass of grouping sets.

    The first aggregate is per (grouping set, series); everything but the pooled R2 and medians
    follows from its sums, so the data is shuffled once.
    """
    o = oof.select("model", "unique_id", "y", "y_hat", *[F.col(s).cast("string").alias(s) for s in slices])
    sets = F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).alias("value")) for s in slices]))
    e = F.col("y") - F.col("y_hat")
    per = (
        o.withColumn("s", sets).select("model", "unique_id", "y", "y_hat", "s.slice", "s.value").where("value is not null")
        .groupBy("model", "slice", "value", "unique_id")
        .agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs"), F.sum(e * e).alias("sq"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.abs("y")).alias("say"), r2(F.col("y"), F.col("y_hat")).alias("r2s"))
    )
    n = F.sum("n")
    return per.groupBy("model", "slice", "value").agg(
        n.alias("n"), (F.sum("abs") / n).alias("mae"), F.sqrt(F.sum("sq") / n).alias("rmse"), F.try_divide(F.sum("abs"), F.sum("say")).alias("wape"),
        F.avg(F.col("abs") / F.col("n")).alias("mae_macro"), F.median(F.when(F.col("n") >= 3, F.col("r2s"))).alias("r2_per_series_median"),
    )


def metric_slices(oof: DataFrame, slices: Sequence[str], *, scales: DataFrame | None = None, levels: Sequence[float] = ()) -> DataFrame:
    """``summarize`` with pooled R2, scaled error, pinball losses and coverage.

    ``scales(unique_id, mase_scale)`` gives the scaled error: the mean over series of their mean ratio, series without
    a positive scale left out.  ``levels`` names quantile columns ``q_<level>``; a metric of quantiles is given only where
    none is missing in the slice.  Everything follows from sums per (model, slice, series): one shuffle of the rows.
    """
    o = oof.join(scales.where("mase_scale > 0"), "unique_id", "left") if scales is not None else oof.withColumn("mase_scale", F.lit(None).cast("double"))
    q = [f"q_{x}" for x in levels]
    sets = F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices]))
    e, y = F.col("y") - F.col("y_hat"), F.col("y")
    loss = lambda c, x: F.greatest(x * (y - F.col(f"`{c}`")), (x - 1) * (y - F.col(f"`{c}`")))
    inside = ((y >= F.col(f"`{q[0]}`")) & (y <= F.col(f"`{q[-1]}`"))).cast("int") if q else F.lit(None).cast("int")
    sums = [F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs"), F.sum(e * e).alias("sq"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.max("mase_scale").alias("scale"), F.sum(inside).alias("inside")]
    sums += [F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(q)] + [F.sum(loss(c, x)).alias(f"l_{i}") for i, (c, x) in enumerate(zip(q, levels))]
    per = o.select("model", "unique_id", "y", "y_hat", "mase_scale", *[F.col(f"`{c}`") for c in q], sets.alias("s")).select("*", "s.slice", "s.value").where("value is not null").groupBy("model", "slice", "value", "unique_id").agg(*sums)
    n = F.sum("n")
    spread = F.sum("syy") - F.sum("sy") * F.sum("sy") / n
    whole = [F.sum(f"n_{i}") == n for i in range(len(q))]
    out = [n.alias("n"), (F.lit(1.0) - F.try_divide(F.sum("sq"), spread)).alias("r2_pooled"), F.avg(F.col("abs") / F.col("n") / F.col("scale")).alias("mase")]
    out += [F.when(whole[i], F.sum(f"l_{i}") / n).alias(f"pinball_{round(x * 100)}") for i, x in enumerate(levels)]
    if q:
        out.append(F.when(whole[0] & whole[-1], F.sum("inside") / n).alias("coverage"))
    return per.groupBy("model", "slice", "value").agg(*out)


def mase_scales(panel: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Mean error of the seasonally adjusted naive forecast over consecutive months."""
    s = F.broadcast(seasonal.select("category", "month", F.col("index").alias("s")))  # categories x 12
    p = panel.withColumn("month", F.month("ds")).join(s, ["category", "month"], "left").withColumn("s", F.coalesce("s", F.lit(1.0)))
    by = Window.partitionBy("unique_id").orderBy("ds")
    p = p.select("unique_id", "y", "s", "ds", F.lag("y").over(by).alias("py"), F.lag("s").over(by).alias("ps"), F.lag("ds").over(by).alias("pds"))
    err = F.when(F.add_months("pds", 1) == F.col("ds"), F.abs(F.col("y") - F.try_divide(F.col("py") * F.col("s"), F.col("ps"))))
    return p.groupBy("unique_id").agg(F.avg(err).alias("mase_scale"))


def mase(oof: DataFrame, scales: DataFrame) -> DataFrame:
    """Mean over series of the mean scaled error; series without a positive scale are left out."""
    per = oof.join(scales.where("mase_scale > 0"), "unique_id").groupBy("model", "unique_id").agg(F.avg(F.abs(F.col("y") - F.col("y_hat")) / F.col("mase_scale")).alias("r"))
    return per.groupBy("model").agg(F.avg("r").alias("mase"))


def leaderboard(summary: DataFrame) -> DataFrame:
    return summary.where("slice = 'overall'").drop("slice", "value").withColumn("rank", F.rank().over(Window.orderBy("mae")))


def horizon_table(oof: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Model x horizon table of mean absolute errors."""
    wide = oof.groupBy("model").pivot("horizon", list(horizons)).agg(mae(F.col("y"), F.col("y_hat")))
    return wide.select("model", *[F.col(f"`{h}`").alias(f"h{h}") for h in horizons])


def horizon_winners(oof: DataFrame, reference: str) -> DataFrame:
    """Best model of each horizon and its gain over the reference model."""
    m = oof.groupBy("horizon", "model").agg(mae(F.col("y"), F.col("y_hat")).alias("mae"))
    return m.groupBy("horizon").agg(F.min_by("model", F.struct("mae", "model")).alias("winner"), F.min("mae").alias("mae"), (F.min("mae") - F.min(F.when(F.col("model") == reference, F.col("mae")))).alias("gain"))


def horizon_coverage(oof: DataFrame) -> DataFrame:
    """How many models and observations stand behind each horizon: the largest number of forecasts of any one model."""
    per = oof.groupBy("horizon", "model").agg(F.count("*").alias("n"))
    return per.groupBy("horizon").agg(F.count("*").alias("models"), F.max("n").alias("observations"))


def horizon_leaders(old: DataFrame, new: DataFrame, reference: str) -> DataFrame:
    """Per horizon the best model of two runs, the reference's error in both, and whether the lead changed."""

    def best(oof: DataFrame, run: str) -> DataFrame:
        m = oof.groupBy("horizon", "model").agg(mae(F.col("y"), F.col("y_hat")).alias("mae"))
        return m.groupBy("horizon").agg(F.min_by("model", F.struct("mae", "model")).alias(f"leader_{run}"), F.min("mae").alias(f"mae_{run}"), F.min(F.when(F.col("model") == reference, F.col("mae"))).alias(f"reference_{run}"))

    both = best(old, "old").join(best(new, "new"), "horizon", "full_outer")
    return both.withColumn("leader_changed", ~F.col("leader_old").eqNullSafe(F.col("leader_new")))


def loss_differences(oof: DataFrame, a: str, b: str) -> DataFrame:
    """Absolute-error difference of two models on their common observations: one pass, no self-join."""
    e = F.abs(F.col("y") - F.col("y_hat"))
    p = oof.where(F.col("model").isin(a, b)).groupBy("unique_id", "ds", "fold").agg(F.avg(F.when(F.col("model") == a, e)).alias("ea"), F.avg(F.when(F.col("model") == b, e)).alias("eb"))
    return p.where("ea is not null and eb is not null").select("unique_id", "ds", "fold", (F.col("ea") - F.col("eb")).alias("d"))


def fold_consistency(oof: DataFrame, a: str, b: str) -> DataFrame:
    """Windows in which ``a`` beats ``b`` and in which it loses, and the mean of the windows."""
    per = loss_differences(oof, a, b).groupBy("fold").agg(F.avg("d").alias("d"))
    return per.agg(F.count("*").alias("folds"), F.count_if(F.col("d") < 0).alias("better"), F.count_if(F.col("d") > 0).alias("worse"), F.avg("d").alias("mean_of_folds"))


def rank_models(errors: DataFrame, block: str) -> DataFrame:
    """Average-tie ranks of models within each block that has all of them, and their mean."""
    models = errors.agg(F.countDistinct("model").alias("k"))
    n = Window.partitionBy(block)
    e = errors.withColumn("in_block", F.count("*").over(n)).crossJoin(F.broadcast(models)).where("in_block = k")
    rank = F.rank().over(n.orderBy("err")) + (F.count("*").over(Window.partitionBy(block, "err")) - 1) / 2
    return e.withColumn("rank", rank).groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("blocks"))


def compare_runs(old: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per model and horizon: error of both runs on shared rows, and how many rows differ."""
    key = ["unique_id", "ds", "fold", "model"]
    j = old.select(*key, "horizon", F.col("y").alias("y"), F.col("y_hat").alias("old")).join(new.select(*key, F.col("y_hat").alias("new")), key)
    return j.groupBy("model", "horizon").agg(F.count("*").alias("n"), mae(F.col("y"), F.col("old")).alias("mae_old"), mae(F.col("y"), F.col("new")).alias("mae_new"), F.count_if(F.abs(F.col("old") - F.col("new")) > tolerance).alias("differing"))


def run_verdicts(compared: DataFrame, numeric: float = 0.01) -> DataFrame:
    """identical / numeric / changed, from the number of differing rows and the size of the change."""
    per = compared.groupBy("model").agg(F.sum("n").alias("n"), F.sum("differing").alias("differing"), F.max(F.abs(F.col("mae_old") - F.col("mae_new"))).alias("shift"))
    return per.withColumn("verdict", F.when(F.col("differing") == 0, "identical").when(F.col("shift") <= numeric, "numeric").otherwise("changed"))


def contributions(table: DataFrame, baseline: str) -> DataFrame:
    """Each configuration's error against the baseline row."""
    base = table.where(F.col("model") == baseline).select(F.col("mae").alias("base"))
    return table.crossJoin(F.broadcast(base)).select("model", "mae", (F.col("mae") - F.col("base")).alias("delta"))


# -- statistics on a handful of numbers, on the driver ---------------------------------------------


def sign_test(better: int, worse: int) -> float:
    """Exact two-sided binomial test of equal odds."""
    n, k = better + worse, min(better, worse)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def student_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def diebold_mariano(d: np.ndarray, horizon: int = 1) -> tuple[float, float, float, int]:
    """Statistic, p, mean and n of loss differences, with autocovariances up to the horizon."""
    d = np.asarray(d, float)
    d = d[np.isfinite(d)]
    n = len(d)
    if n < 3:
        return math.nan, math.nan, float(d.mean()) if n else math.nan, n
    c = d - d.mean()
    var = float(c @ c) / n + 2 * sum(float(c[k:] @ c[:-k]) / n for k in range(1, horizon))
    if var <= 0:
        return math.nan, math.nan, float(d.mean()), n
    stat = float(d.mean() / math.sqrt(var / n) * math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n))
    return stat, student_tail(stat, n - 1), float(d.mean()), n


def panel_dm(oof: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``horizon, a, b, n, mean, stat``: loss differences averaged by series, the series being the sample of the test."""
    e = F.abs(F.col("y") - F.col("y_hat"))
    names = sorted({m for p in pairs for m in p})
    wide = oof.where(F.col("model").isin(*names)).groupBy("horizon", "unique_id", "ds", "fold").agg(*[F.avg(F.when(F.col("model") == m, e)).alias(m) for m in names])
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs]))
    per = wide.select("horizon", "unique_id", both.alias("p")).select("horizon", "unique_id", "p.*").where("d is not null").groupBy("horizon", "a", "b", "unique_id").agg(F.avg("d").alias("d"))
    out = per.groupBy("horizon", "a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("v"))
    n = F.col("n")
    return out.select("horizon", "a", "b", "n", "mean", F.when((n >= 3) & (F.col("v") > 0), F.col("mean") / F.sqrt(F.col("v") / n) * F.sqrt((n - 1) / n)).alias("stat"))


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square law, by series or continued fraction of the gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        num = -k * (k - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def friedman(mean_ranks: Sequence[float], blocks: int) -> tuple[float, float]:
    """Friedman statistic and p from mean ranks (no tie correction)."""
    k = len(mean_ranks)
    stat = 12 * blocks / (k * (k + 1)) * sum((r - (k + 1) / 2) ** 2 for r in mean_ranks)
    return stat, chi_square_tail(stat, k - 1)


def studentized_range_quantile(k: int, alpha: float = 0.05) -> float:
    """Upper quantile of the range of k standard normals (infinite degrees of freedom)."""
    x = np.linspace(-8, 8, 4001)
    pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    lo, hi = 0.0, 20.0
    for _ in range(60):
        q = (lo + hi) / 2
        shifted = np.interp(x + q, x, cdf, right=1.0)
        p = k * np.trapezoid(pdf * (shifted - cdf) ** (k - 1), x)
        lo, hi = (q, hi) if p < 1 - alpha else (lo, q)
    return q


def nemenyi_difference(k: int, n: int, alpha: float = 0.05) -> float:
    return studentized_range_quantile(k, alpha) / math.sqrt(2) * math.sqrt(k * (k + 1) / (6.0 * n))
