"""Forecast models behind a registry: local ones per series, global ones as MLlib pipelines.

A model is ``f(train, folds, options) -> fold, unique_id, ds, model, y_hat``.  Local models see one
series at a time inside ``applyInPandas``, whose group is a series of a fold: at most one row per
month.  ETS, Theta, AR and the trend-plus-season regression are compact re-implementations, not the
libraries of those names; neural and foundation models need weights that are not available here and
can be registered the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.operators.backtest import split_train
from kronopanel.operators.features import direct_rows, forecast_from_ratio, lag_features

Model = Callable[..., DataFrame]
_MODELS: dict[str, Model] = {}


def register(name: str) -> Callable[[Model], Model]:
    def keep(f: Model) -> Model:
        if name in _MODELS:
            raise ValueError(f"model {name} is registered already")
        _MODELS[name] = f
        return f

    return keep


def get(name: str) -> Model:
    if name not in _MODELS:
        raise KeyError(f"no model {name}; known: {sorted(_MODELS)}")
    return _MODELS[name]


# -- local models ----------------------------------------------------------------------------------


def _smooth(y: np.ndarray, alpha: float, beta: float) -> tuple[float, float, float]:
    """Level, trend and squared error of Holt's damped linear smoothing."""
    level, trend, err = y[0], 0.0, 0.0
    for v in y[1:]:
        guess = level + 0.9 * trend
        e = v - guess
        err += e * e
        level = guess + alpha * e
        trend = 0.9 * trend + alpha * beta * e
    return level, trend, err


def ets(y: np.ndarray, h: int) -> np.ndarray:
    """Damped exponential smoothing, parameters by grid on one-step error."""
    grid = [(a, b) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.0, 0.1, 0.3)]
    level, trend, _ = min((_smooth(y, a, b) for a, b in grid), key=lambda r: r[2])
    return level + trend * np.cumsum(0.9 ** np.arange(1, h + 1))


def theta(y: np.ndarray, h: int) -> np.ndarray:
    """Mean of the linear trend and simple smoothing of the doubled curvature."""
    t = np.arange(len(y))
    slope, base = np.polyfit(t, y, 1) if len(y) > 1 else (0.0, y[0])
    line = base + slope * t
    level = min((_smooth(2 * y - line, a, 0.0) for a in (0.1, 0.3, 0.5, 0.8)), key=lambda r: r[2])[0]
    return (level + base + slope * (len(y) - 1 + np.arange(1, h + 1))) / 2


def autoregression(y: np.ndarray, h: int) -> np.ndarray:
    """AR(1..3) on differences by ridge, order by a penalised error."""
    d = np.diff(y)
    best = (np.inf, None)
    for p in (1, 2, 3):
        if len(d) < p + 4:
            continue
        x = np.stack([d[p - k - 1 : len(d) - k - 1] for k in range(p)], axis=1)
        w = np.linalg.solve(x.T @ x + 1e-3 * np.eye(p) * (1 + np.trace(x.T @ x)), x.T @ d[p:])
        e = d[p:] - x @ w
        cost = len(e) * np.log(e @ e / len(e) + 1e-12) + 2 * p
        if cost < best[0]:
            best = (cost, w)
    if best[1] is None:
        return np.full(h, y[-1])
    past, last, out = list(d[::-1][: len(best[1])]), y[-1], []
    for _ in range(h):
        step = float(np.dot(best[1], past))
        past = [step, *past][: len(best[1])]
        last += step
        out.append(last)
    return np.array(out)


def trend_season(y: np.ndarray, h: int) -> np.ndarray:
    """Ridge on a linear trend and yearly Fourier terms; strength by a held-out tail."""
    t = np.arange(len(y) + h)
    x = np.stack([np.ones(len(t)), t / 12, *[f(2 * np.pi * k * t / 12) for k in (1, 2) for f in (np.sin, np.cos)]], axis=1)
    cut = max(len(y) - 3, 2)

    def fit(n: int, ridge: float) -> np.ndarray:
        return np.linalg.solve(x[:n].T @ x[:n] + ridge * np.diag([1e-6, 1, 1, 1, 1, 1]), x[:n].T @ y[:n])

    ridge = min((0.1, 1.0, 10.0), key=lambda r: float(np.abs(y[cut:] - x[cut : len(y)] @ fit(cut, r)).sum()))
    return x[len(y) :] @ fit(len(y), ridge)


def _local(name: str, f: Callable[[np.ndarray, int], np.ndarray]) -> None:
    def model(panel: DataFrame, folds: DataFrame, min_train_obs: int = 6) -> DataFrame:
        train = split_train(panel, folds, min_train_obs).groupBy("fold", "unique_id", "cutoff", "horizon").agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("h"))

        def run(batches):  # noqa: ANN001, ANN202
            for pdf in batches:
                parts = []
                for fold, uid, cutoff, h, y in zip(pdf["fold"], pdf["unique_id"], pdf["cutoff"], pdf["horizon"], pdf["y"]):
                    y = np.asarray(y, float)
                    y_hat = np.maximum(0.0, np.nan_to_num(f(y, int(h)), nan=float(y[-1])))
                    parts.append(pd.DataFrame({"fold": fold, "unique_id": uid, "ds": [(pd.Timestamp(cutoff) + pd.DateOffset(months=k + 1)).date() for k in range(int(h))], "model": name, "y_hat": y_hat}))
                if parts:
                    yield pd.concat(parts, ignore_index=True)

        return train.select("fold", "unique_id", "cutoff", "horizon", F.col("h.y").alias("y")).mapInPandas(run, "fold string, unique_id string, ds date, model string, y_hat double")

    register(name)(model)


for _n, _f in (("ets", ets), ("theta", theta), ("ar", autoregression), ("trend_season", trend_season)):
    _local(_n, _f)


# -- global model ----------------------------------------------------------------------------------

FEATURES = ("lag_1", "lag_2", "lag_3", "roll_mean_3", "roll_std_3", "roll_mean_6", "n_history", "step", "month")


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    x = rows.withColumn("month", F.month("ds")).select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"x_{c}") for c in FEATURES])
    return VectorAssembler(inputCols=[f"x_{c}" for c in FEATURES], outputCol="features").transform(x)


@register("gbt")
def gradient_boosting(panel: DataFrame, fold: tuple[str, str, int], *, seasonal: DataFrame | None = None, trees: int = 20, depth: int = 4) -> DataFrame:
    """Direct multi-step boosted trees on lag features, trained on origins whose targets are known.

    Absolute loss on log ratios; NULL features take a value outside their range.
    """
    from pyspark.ml.regression import GBTRegressor

    name, cutoff, horizon = fold
    known = panel.where(F.col("ds") <= F.lit(cutoff).cast("date"))
    train = _assembled(direct_rows(known, horizon, seasonal=seasonal)).select("features", F.col("target").alias("label"))
    model = GBTRegressor(lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7, maxBins=64).fit(train)
    now = lag_features(known).where(F.col("origin") == F.lit(cutoff).cast("date"))
    rows = now.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.add_months("origin", F.col("step")))
    out = model.transform(_assembled(rows))
    return out.select(F.lit(name).alias("fold"), "unique_id", "ds", F.lit("gbt").alias("model"), forecast_from_ratio(F.col("y_last"), F.col("prediction")).alias("y_hat"))


# -- quantiles and ensembles -----------------------------------------------------------------------


def residual_quantiles(history: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Relative residual quantiles per model and horizon: intervals for models that give none."""
    r = F.try_divide(F.col("y") - F.col("y_hat"), F.col("y_hat"))
    return history.groupBy("model", "horizon").agg(*[F.percentile(r, float(q)).alias(f"r_{q}") for q in levels])


def with_quantiles(oof: DataFrame, quantiles: DataFrame, levels: Sequence[float]) -> DataFrame:
    q = oof.join(F.broadcast(quantiles), ["model", "horizon"], "left")  # models x horizons
    return q.select(*oof.columns, *[F.greatest(F.lit(0.0), F.col("y_hat") * (1 + F.coalesce(F.col(f"`r_{x}`"), F.lit(0.0)))).alias(f"q_{x}") for x in levels])


def fit_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Simplex weights of least squared error from its sufficient statistics.

    Models enter one at a time while the error falls in their direction and leave when their weight would turn
    negative; on the models that carry weight the sum-to-one system is solved exactly.  Ends when no model can enter.
    """
    k = len(cross)
    scale = max(float(np.abs(gram).max()), 1e-300)
    g, c = gram / scale + 1e-12 * np.eye(k), cross / scale
    active = [int(np.argmin(np.diag(g) - 2 * c))]
    w = np.zeros(k)
    w[active] = 1.0
    for _ in range(10 * k + 10):
        slope = 2 * (g @ w - c)
        best = min(slope[active])
        enter = int(np.argmin(slope))
        if slope[enter] >= best - 1e-10 or enter in active:
            break
        active.append(enter)
        while True:
            m = len(active)
            system = np.block([[2 * g[np.ix_(active, active)], np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
            target = np.linalg.lstsq(system, np.append(2 * c[active], 1.0), rcond=None)[0][:m]
            if (target > 0).all():
                w[:] = 0
                w[active] = target
                break
            now = w[active]
            fall = target <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = float(np.min(np.where(fall, now / (now - target), np.inf)))
            w[active] = now + step * (target - now)
            active = [i for i in active if w[i] > 1e-12] or [int(np.argmax(w))]
            w[[i for i in range(k) if i not in active]] = 0
    return w / w.sum()


def least_absolute_weights(history: DataFrame, models: Sequence[str], *, group: str = "group", rounds: int = 25, tolerance: float = 1e-4) -> DataFrame:
    """``group, model, weight``: simplex weights of least absolute error, all groups at once.

    ``history`` has a row per observation with the group, ``y`` and a column per model.  Iteratively reweighted least
    squares: each round is one aggregate over the history into sums of products (models squared numbers per group)
    and a solve on those; it ends when no weight moves by more than ``tolerance``.  A model that lacks a forecast of
    any observation of a group gets no weight there; fewer than two such models share it equally.
    """
    from kronopanel.session import materialize

    spark, k = history.sparkSession, len(models)
    h = materialize(history.select(F.col(group).cast("string").alias("g"), F.col("y").cast("double").alias("y"), *[F.col(f"`{m}`").cast("double").alias(f"x{i}") for i, m in enumerate(models)]).where("y is not null"), "history")
    x = [F.coalesce(F.col(f"x{i}"), F.lit(0.0)) for i in range(k)]
    counts = h.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.abs("y")).alias("level"), *[F.count(f"x{i}").alias(f"c{i}") for i in range(k)]).collect()  # a row per group
    usable = {r.g: [i for i in range(k) if r[f"c{i}"] == r.n] for r in counts}
    level = {r.g: float(r.level or 1.0) for r in counts}
    weights = {r.g: np.array([1.0 / max(len(usable[r.g]), 1) if i in usable[r.g] else 0.0 for i in range(k)]) if len(usable[r.g]) > 1 else np.full(k, 1.0 / k) for r in counts}
    moving = {g for g, own in usable.items() if len(own) > 1}
    for _ in range(rounds):
        if not moving:
            break
        now = spark.createDataFrame([(g, 1e-6 * level[g] + 1e-12, *map(float, weights[g])) for g in sorted(moving)], "g string, floor double, " + ", ".join(f"w{i} double" for i in range(k)))
        r = sum((x[i] * F.col(f"w{i}") for i in range(1, k)), x[0] * F.col("w0"))
        v = 1 / F.greatest(F.abs(F.col("y") - r), F.col("floor"))
        sums = [F.sum(F.col("v") * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("v") * x[i] * F.col("y")).alias(f"c{i}") for i in range(k)]
        still = set()
        for row in h.join(F.broadcast(now), "g").withColumn("v", v).groupBy("g").agg(*sums).collect():  # a row per group
            own = usable[row.g]
            gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in own] for i in own])
            new = np.zeros(k)
            new[own] = fit_weights(gram, np.array([row[f"c{i}"] for i in own]))
            if np.abs(new - weights[row.g]).max() > tolerance:
                still.add(row.g)
            weights[row.g] = new
        moving = still
    return spark.createDataFrame([(g, m, float(w[i])) for g, w in sorted(weights.items()) for i, m in enumerate(models)], "group string, model string, weight double")


def rolling_origin_weights(oof: DataFrame, models: Sequence[str], *, by: str | None = None) -> DataFrame:
    """``horizon, fold, [by,] model, weight``: weights of each fold from what was known at its cutoff.

    The history of a fold are the observations of all other folds, of every horizon, whose month is not after the
    cutoff; a fold without history weighs its models equally.
    """
    keys = ["unique_id", "ds", "fold"]
    folds = oof.groupBy("fold").agg(F.min("cutoff").alias("cut"), F.min("horizon").alias("horizon"))  # one row per window
    wide = oof.where(F.col("model").isin(*models)).groupBy(*keys, *([by] if by else [])).agg(F.max("y").alias("y"), *[F.avg(F.when(F.col("model") == m, F.col("y_hat"))).alias(m) for m in models])
    past = wide.withColumnRenamed("fold", "past").join(F.broadcast(folds), (F.col("ds") <= F.col("cut")) & (F.col("past") != F.col("fold")))
    label = F.concat_ws("|", "fold", *([by] if by else []))
    fitted = least_absolute_weights(past.withColumn("group", label), models).select("group", "model", "weight")
    every = oof.select("fold", *([by] if by else [])).distinct().join(F.broadcast(folds.select("fold", "horizon")), "fold").withColumn("group", label).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(F.broadcast(fitted), ["group", "model"], "left").select("horizon", "fold", *([by] if by else []), "model", F.coalesce("weight", F.lit(1.0 / len(models))).alias("weight"))


def rolling_origin_ensemble(oof: DataFrame, models: Sequence[str], *, by: str | None = None, name: str = "ensemble") -> DataFrame:
    """The ensemble's forecast of every observation that all its weighted models predicted, with the observation's own columns.

    Quantiles are averaged over the models that have them and recentred on the point forecast.
    """
    w = rolling_origin_weights(oof, models, by=by)
    on = ["fold", *([by] if by else [])]
    out = combine(oof.where(F.col("model").isin(*models)), w.drop("horizon"), on)
    return attach_observation(out.withColumn("model", F.lit(name)), oof)


def attach_observation(frame: DataFrame, oof: DataFrame) -> DataFrame:
    """Columns of the observation (cutoff, step, slices) for a derived forecast; never those of one model's prediction."""
    keys = ["unique_id", "ds", "fold"]
    own = [c for c in oof.columns if c not in frame.columns and c not in ("model", "y", "y_hat") and not c.startswith("q_")]
    if not own:
        return frame
    return frame.join(oof.groupBy(*keys).agg(*[F.min(f"`{c}`").alias(c) for c in own]), keys, "left")


def weights_as_of(oof: DataFrame, cutoff: str, models: Sequence[str], group: str | None = None) -> DataFrame:
    """Ensemble weights from forecasts whose target month is not after ``cutoff``.

    The data contributes sums of products of models' predictions (models squared numbers per group);
    the solve runs on those.  Fewer than two models with history give equal weights.
    """
    past = oof.where((F.col("ds") <= F.lit(cutoff).cast("date")) & F.col("model").isin(*models))
    keys = ["unique_id", "ds", "fold", *([group] if group else [])]
    wide = past.groupBy(*keys).pivot("model", list(models)).agg(F.avg("y_hat")).join(past.groupBy(*keys).agg(F.max("y").alias("y")), keys)
    full = wide.dropna(subset=[*models, "y"])
    sums = [F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"g{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j]
    sums += [F.sum(F.col(f"`{a}`") * F.col("y")).alias(f"c{i}") for i, a in enumerate(models)]
    stats = (full.groupBy(group) if group else full.groupBy(F.lit("all").alias("group"))).agg(F.count("*").alias("n"), *sums)
    k = len(models)
    name = group or "group"

    def solve(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                w = fit_weights(g, np.array([r[f"c{i}"] for i in range(k)], float)) if r["n"] and k > 1 else np.full(k, 1.0 / k)
                yield pd.DataFrame({name: r[name], "model": list(models), "weight": w})

    return stats.mapInPandas(solve, f"{name} string, model string, weight double")


def combine(oof: DataFrame, weights: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Weighted forecast over the models present; quantiles over those that have them, recentred."""
    q = [c for c in oof.columns if c.startswith("q_")]
    j = oof.join(F.broadcast(weights), ["model", *on])
    keys = ["unique_id", "ds", "fold"]
    w = F.col("weight")
    avg = lambda c: F.try_divide(F.sum(F.when(F.col(f"`{c}`").isNotNull(), w * F.col(f"`{c}`"))), F.sum(F.when(F.col(f"`{c}`").isNotNull(), w)))
    out = j.groupBy(*keys).agg(F.max("y").alias("y"), avg("y_hat").alias("y_hat"), *[avg(c).alias(c) for c in q])
    if "q_0.5" in q:
        shift = F.col("y_hat") - F.col("`q_0.5`")
        out = out.select(*keys, "y", "y_hat", *[(F.col(f"`{c}`") + shift).alias(c) for c in q])
    return out.withColumn("model", F.lit("ensemble"))


# -- probability of a break ------------------------------------------------------------------------


def hazard_probabilities(table: DataFrame, label: str, features: Sequence[str], *, train_share: float = 0.6, trees: int = 20, seed: int = 7) -> DataFrame:
    """Boosted-tree probability that a break is near; series are split by hash into train and test."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = table.select("unique_id", "t", F.col(label).cast("double").alias("label"), *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(-9.0)), F.lit(-9.0)).alias(f) for f in features])
    x = VectorAssembler(inputCols=list(features), outputCol="features").transform(x).withColumn("train", F.pmod(F.xxhash64(F.lit(seed), "unique_id"), F.lit(1000)) < int(train_share * 1000))
    model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed).fit(x.where("train"))
    return model.transform(x.where("not train")).select("unique_id", "t", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("p"))


def best_threshold(scored: DataFrame, steps: int = 50) -> DataFrame:
    """Threshold of best F1 over a grid of probabilities, in one aggregate."""
    s = scored.withColumn("bin", F.floor(F.col("p") * steps)).groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most `steps` rows
    total = s.agg(F.sum("hits").alias("total"))
    t = s.select((F.col("bin") / steps).alias("threshold"), F.sum("n").over(above).alias("n"), F.sum("hits").over(above).alias("hits")).crossJoin(F.broadcast(total))
    return t.withColumn("f1", F.try_divide(2.0 * F.col("hits"), F.col("n") + F.col("total"))).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def threshold_for_rate(scored: DataFrame, rate: float) -> DataFrame:
    """Threshold above which a given share of rows lies."""
    return scored.agg(F.percentile("p", 1 - rate).alias("threshold"))
