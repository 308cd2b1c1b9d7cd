"""Structural breaks: residual streams, online and offline detectors, scoring, synthetic breaks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- streams ---------------------------------------------------------------------------------------


def array_median(values: Column) -> Column:
    """Median of a non-empty array without NULLs."""
    s = F.sort_array(values)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def naive_residuals(panel: DataFrame, seasonal: DataFrame | None = None) -> DataFrame:
    """One-step residual of the previous row, seasonally adjusted if an index is given (row-based lag)."""
    p = panel.withColumn("s", F.lit(1.0))
    if seasonal is not None:
        idx = F.broadcast(seasonal.select("category", "month", F.col("index").alias("sx")))  # categories x 12
        p = panel.withColumn("month", F.month("ds")).join(idx, ["category", "month"], "left").withColumn("s", F.coalesce("sx", F.lit(1.0)))
    by = Window.partitionBy("unique_id").orderBy("ds")
    expected = F.lag("y").over(by) * F.col("s") / F.greatest(F.lag("s").over(by), F.lit(1e-9))
    return p.select("unique_id", "ds", (F.row_number().over(by) - 1).alias("t"), (F.col("y") - expected).alias("residual"))


def causal_zscores(stream: DataFrame, value: str, *, center: bool, min_history: int = 3) -> DataFrame:
    """Value against the median and MAD of strictly earlier values of its series.

    The growing history is an array of at most the series' length; a zero MAD falls back to the
    population deviation.
    """
    past = Window.partitionBy("unique_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    s = stream.withColumn("past", F.collect_list(value).over(past)).withColumn("med", F.when(F.size("past") >= min_history, array_median(F.col("past"))))
    s = s.withColumn("mad", F.when(F.col("med").isNotNull(), array_median(F.transform("past", lambda x: F.abs(x - F.col("med"))))))
    mean = F.aggregate("past", F.lit(0.0), lambda a, x: a + x) / F.size("past")
    sd = F.sqrt(F.aggregate(F.transform("past", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size("past"))
    scale = F.greatest(F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(sd), F.lit(1e-9))
    shift = F.col("med") if center else F.lit(0.0)
    return s.withColumn("z", F.when(F.col("med").isNotNull(), (F.col(value) - shift) / scale)).drop("past", "med", "mad")


def standardized(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Value over its key's 1.4826 MAD (population deviation where that is zero)."""
    med = rows.groupBy(key).agg(F.median(value).alias("med"), F.stddev_pop(value).alias("sd"))
    r = rows.join(med, key)
    mad = r.groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return r.join(mad, key).withColumn("z", F.col(value) / F.greatest(F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.col("sd")), F.lit(1e-9))).drop("med", "sd", "mad")


def noise_units(series: DataFrame) -> DataFrame:
    """Series from its median in units of its own noise: MAD of differences, with fallbacks."""
    by = Window.partitionBy("unique_id").orderBy("t")
    d = series.withColumn("d", F.col("y") - F.lag("y").over(by))
    a = d.groupBy("unique_id").agg(F.median("y").alias("level"), F.median("d").alias("md"), F.stddev_pop("d").alias("sd"), F.greatest(F.max(F.abs("y")), F.lit(1.0)).alias("top"))
    d = d.join(a, "unique_id")
    mad = d.groupBy("unique_id").agg(F.median(F.abs(F.col("d") - F.col("md"))).alias("mad"))
    floor = F.col("top") * 1e-9
    raw = F.when(F.col("mad") > floor, F.col("mad") * 1.4826).otherwise(F.col("sd"))
    scale = F.when(raw > floor, raw / math.sqrt(2.0)).otherwise(1.0)
    return d.join(mad, "unique_id").select("unique_id", "t", ((F.col("y") - F.col("level")) / scale).alias("x"), scale.alias("scale"))


# -- online detectors: left folds over a series' array, inside the JVM ------------------------------


def series_arrays(stream: DataFrame, value: str, keys: Sequence[str] = ("unique_id",)) -> DataFrame:
    """One row per series with its values in order; NULL and NaN become 0, as the detectors expect."""
    x = F.coalesce(F.nanvl(F.col(value), F.lit(None).cast("double")), F.lit(0.0))
    return stream.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), x.alias("x")))).alias("xs"))


def cusum_alarms(arrays: DataFrame, threshold: float | Column, drift: float = 0.5) -> DataFrame:
    """Two-sided CUSUM; an alarm where the larger sum exceeds the threshold, then both restart."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.array().cast("array<int>").alias("a"))

    def step(s: Column, v: Column) -> Column:
        p = F.greatest(F.lit(0.0), s["p"] + v["x"] - drift)
        n = F.greatest(F.lit(0.0), s["n"] - v["x"] - drift)
        hit = F.greatest(p, n) > thr
        return F.struct(F.when(hit, 0.0).otherwise(p).alias("p"), F.when(hit, 0.0).otherwise(n).alias("n"), F.when(hit, F.array_append(s["a"], v["t"])).otherwise(s["a"]).alias("a"))

    return arrays.withColumn("alarms", F.aggregate("xs", start, step)["a"])


def page_hinkley_alarms(arrays: DataFrame, threshold: float | Column, delta: float = 0.05) -> DataFrame:
    """Page-Hinkley test of a shift of the mean; everything restarts after an alarm."""
    zero = lambda name: F.lit(0.0).alias(name)
    start = F.struct(zero("m"), zero("c"), zero("lo"), zero("hi"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("a"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        m = s["m"] + (v["x"] - s["m"]) / n
        c = s["c"] + (v["x"] - m - delta)
        lo, hi = F.least(s["lo"], c), F.greatest(s["hi"], c)
        hit = F.greatest(c - lo, hi - c) > threshold
        keep = lambda x, name: F.when(hit, 0.0).otherwise(x).alias(name)
        return F.struct(keep(m, "m"), keep(c, "c"), keep(lo, "lo"), keep(hi, "hi"), F.when(hit, 0).otherwise(n).alias("n"), F.when(hit, F.array_append(s["a"], v["t"])).otherwise(s["a"]).alias("a"))

    return arrays.withColumn("alarms", F.aggregate("xs", start, step)["a"])


def conformal_alarms(flags: DataFrame, consecutive: int = 2) -> DataFrame:
    """Alarm at each ``consecutive``-th flag of a run: runs are islands between unflagged rows."""
    by = Window.partitionBy("unique_id").orderBy("t")
    f = flags.withColumn("island", F.sum(1 - F.col("flag")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("flag = 1")
    return f.withColumn("k", F.row_number().over(Window.partitionBy("unique_id", "island").orderBy("t"))).where(F.col("k") % consecutive == 0).select("unique_id", "t")


def schedule_alarms(lengths: DataFrame, period: int) -> DataFrame:
    """Alarms every ``period`` points whatever the data: what a detector has to beat."""
    return lengths.where(F.col("n") > period).select("unique_id", F.explode(F.sequence(F.lit(period).cast("long"), F.col("n").cast("long") - 1, F.lit(period).cast("long"))).alias("t"))


# -- sequential models in Python: one Arrow batch of whole series at a time -------------------------


def _per_series(arrays: DataFrame, f: Callable[[np.ndarray], list[int]]) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame({"unique_id": pdf["unique_id"], "alarms": [[int(i) for i in f(np.asarray(x, float))] for x in pdf["x"]]})

    return arrays.select("unique_id", F.col("xs.x").alias("x")).mapInPandas(run, "unique_id string, alarms array<int>")


def run_lengths(x: np.ndarray, hazard: float = 1 / 12) -> tuple[np.ndarray, np.ndarray]:
    """Bayesian online detection: likeliest run length after each value, and the mass on runs of at most two.

    Normal-gamma observations, Student-t predictions.
    """
    mu, kappa, alpha, beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    log_run, likely, short = np.zeros(1), np.zeros(len(x), int), np.zeros(len(x))
    for t, v in enumerate(x):
        df, scale2 = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
        lg = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in df])
        pred = lg - 0.5 * np.log(np.pi * df * scale2) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale2))
        grow = log_run + pred + math.log1p(-hazard)
        new = np.logaddexp.reduce(log_run + pred + math.log(hazard))
        log_run = np.concatenate(([new], grow))
        log_run -= np.logaddexp.reduce(log_run)
        beta = np.concatenate(([1.0], beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))))
        mu = np.concatenate(([0.0], (kappa * mu + v) / (kappa + 1)))
        kappa, alpha = np.concatenate(([1.0], kappa + 1)), np.concatenate(([1.0], alpha + 0.5))
        likely[t], short[t] = int(np.argmax(log_run)), float(np.exp(log_run[:3]).sum())
    return likely, short


def bocpd(x: np.ndarray, hazard: float = 1 / 12, drop: float = 0.25, confirm: int = 2) -> list[int]:
    """Alarm where the likeliest run length falls while short runs have a mass of ``drop``, and the new run then
    grows by one in each of ``confirm`` steps; the alarm is dated at its confirmation."""
    likely, short = run_lengths(x, hazard)
    falls = [t for t in range(1, len(x) - confirm) if likely[t] < likely[t - 1] and short[t] >= drop]
    return [t + confirm for t in falls if all(likely[t + k] == likely[t] + k for k in range(1, confirm + 1))]


def conformal_runs(x: np.ndarray, limit: float, consecutive: int = 2) -> list[int]:
    """Positions at which ``consecutive`` values in a row lie beyond the limit; a run starts anew after each."""
    out, run = [], 0
    for t, v in enumerate(np.abs(x) > limit):
        run = run + 1 if v else 0
        if run == consecutive:
            out.append(t)
            run = 0
    return out


def adwin(x: np.ndarray, delta: float = 0.05, least: int = 3) -> list[int]:
    """Adaptive window: drop the older part whenever the means of two parts differ too much."""
    start, alarms = 0, []
    for t in range(len(x)):
        w = x[start : t + 1]
        n = len(w)
        if n < 2 * least:
            continue
        s = np.cumsum(w)
        k = np.arange(least, n - least + 1)
        m0, m1 = s[k - 1] / k, (s[-1] - s[k - 1]) / (n - k)
        harmonic = 1 / (1 / k + 1 / (n - k))
        d = math.log(2 * math.log(max(n, 3)) / delta)
        cut = np.sqrt(2 / harmonic * w.var() * d) + 2 / (3 * harmonic) * d
        over = np.abs(m0 - m1) > cut
        if over.any():
            start += int(k[np.argmax(np.abs(m0 - m1) - cut)])
            alarms.append(t)
    return alarms


class _SquaredLoss:
    """Cost of a segment around its mean, by prefix sums."""

    def __init__(self, x: np.ndarray):
        self.s, self.q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))

    def __call__(self, a, b):  # noqa: ANN001, ANN204
        return self.q[b] - self.q[a] - (self.s[b] - self.s[a]) ** 2 / (b - a)


class _KernelLoss:
    """Cost of a segment in the feature space of a Gaussian kernel, by a summed Gram matrix."""

    def __init__(self, x: np.ndarray):
        d = (x[:, None] - x[None, :]) ** 2
        positive = d[d > 0]
        gram = np.exp(-d / (np.median(positive) if len(positive) else 1.0))
        self.g = np.zeros((len(x) + 1, len(x) + 1))
        self.g[1:, 1:] = gram.cumsum(0).cumsum(1)

    def __call__(self, a, b):  # noqa: ANN001, ANN204
        return (b - a) - (self.g[b, b] - self.g[a, b] - self.g[b, a] + self.g[a, a]) / (b - a)


def optimal_breaks(x: np.ndarray, penalty: float, least: int = 3, kernel: bool = False) -> list[int]:
    """Penalised optimal segmentation with pruning of start points that can never win again."""
    n = len(x)
    if n < 2 * least:
        return []
    cost = (_KernelLoss if kernel else _SquaredLoss)(x)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    starts = np.array([0])
    for b in range(least, n + 1):
        ok = starts[starts <= b - least]
        total = best[ok] + cost(ok, b) + penalty
        k = int(np.argmin(total))
        best[b], last[b] = total[k], ok[k]
        alive = np.concatenate((ok[total - penalty <= best[b]], starts[starts > b - least]))
        starts = np.append(alive, b)
    out, b = [], n
    while last[b] > 0:
        b = int(last[b])
        out.append(b)
    return out[::-1]


def binary_breaks(x: np.ndarray, penalty: float, least: int = 3) -> list[int]:
    """Binary segmentation: split the best segment while the gain exceeds the penalty."""
    cost, out, todo = _SquaredLoss(x), [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * least:
            continue
        k = np.arange(a + least, b - least + 1)
        gain = cost(a, b) - cost(a, k) - cost(k, b)
        i = int(np.argmax(gain))
        if gain[i] > penalty:
            out.append(int(k[i]))
            todo += [(a, int(k[i])), (int(k[i]), b)]
    return sorted(out)


def window_breaks(x: np.ndarray, penalty: float, least: int = 3) -> list[int]:
    """Peaks of the discrepancy between the halves of a sliding window."""
    half = max(least, 3)
    if len(x) < 2 * half:
        return []
    cost = _SquaredLoss(x)
    k = np.arange(half, len(x) - half + 1)
    gain = cost(k - half, k + half) - cost(k - half, k) - cost(k, k + half)
    return [int(k[i]) for i in range(len(k)) if gain[i] > penalty and gain[i] == gain[max(0, i - least + 1) : i + least].max()]


DETECTORS: dict[str, Callable[..., list[int]]] = {"pelt_l2": optimal_breaks, "pelt_rbf": lambda x, penalty: optimal_breaks(x, penalty, kernel=True), "kernel_rbf": lambda x, penalty: optimal_breaks(x, penalty, kernel=True), "binseg_l2": binary_breaks, "window_l2": window_breaks, "bocpd": lambda x, drop: bocpd(x, drop=drop), "adwin": lambda x, delta: adwin(x, delta), "conformal": conformal_runs}


def detect(arrays: DataFrame, name: str, parameter: float) -> DataFrame:
    """``unique_id, alarms`` of a named sequential detector."""
    f = DETECTORS[name]
    return _per_series(arrays, lambda x: f(x, parameter))


def grid_alarms(arrays: DataFrame, grid: dict[str, Sequence[float]]) -> DataFrame:
    """``unique_id, detector, parameter, alarms``: every detector at every parameter, series by series in one pass over the stream."""
    folds = {"cusum": cusum_alarms, "page_hinkley": page_hinkley_alarms}
    cols = ["unique_id", "detector", "parameter", "alarms"]
    parts = []
    for name in grid.keys() & folds.keys():
        wide = arrays.withColumn("parameter", F.explode(F.array(*[F.lit(float(v)) for v in grid[name]])))
        parts.append(folds[name](wide, F.col("parameter")).withColumn("detector", F.lit(name)).select(*cols))
    rest = [(name, float(v), DETECTORS[name]) for name in sorted(grid.keys() - folds.keys()) for v in grid[name]]
    if rest:

        def run(batches):  # noqa: ANN001, ANN202
            for pdf in batches:
                series = [(u, np.asarray(x, float)) for u, x in zip(pdf["unique_id"], pdf["x"])]
                yield pd.DataFrame([(u, name, v, [int(i) for i in f(x, v)]) for u, x in series for name, v, f in rest], columns=cols)

        parts.append(arrays.select("unique_id", F.col("xs.x").alias("x")).mapInPandas(run, "unique_id string, detector string, parameter double, alarms array<int>"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def calibrated(alarms: DataFrame, labels: DataFrame, margin: int = 1) -> DataFrame:
    """Each detector at the parameter with the best F1 on one half of the series (the least of equals), scored on the other half.

    The halves are drawn by a hash of the series; ``alarms`` holds a row per series, detector and parameter.
    """
    half = F.pmod(F.xxhash64("unique_id"), F.lit(2))
    keys = ["detector", "parameter"]
    first = score(alarms, labels.where(half == 0), margin, keys)
    best = first.groupBy("detector").agg(F.max_by("parameter", F.struct("f1", -F.col("parameter"))).alias("parameter"), F.max("f1").alias("f1_calibration"))
    chosen = alarms.join(F.broadcast(best), keys)  # a row per detector
    return score(chosen, labels.where(half == 1), margin, keys).join(best, keys)


def delay_curve(alarms: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean delay of the detected breaks against false alarms per series-year, for each detector and parameter."""
    keys = ["detector", "parameter"]
    j = labels.where("tau >= 0").join(alarms, "unique_id")
    delay = F.array_min(F.filter("alarms", lambda a: a >= F.col("tau"))) - F.col("tau")
    late = j.groupBy(*keys).agg(F.avg(delay).alias("mean_delay"), F.count(delay).alias("detected"))
    return score(alarms, labels, 1, keys).join(late, keys, "left").select(*keys, "false_per_year", "recall", "mean_delay", "detected")


def window_coverage(alarms: Column, n: Column, margin: int) -> Column:
    """Share of a series' positions within ``margin`` of an alarm: how often a random date would be found."""
    near = F.flatten(F.transform(alarms, lambda a: F.sequence(F.greatest(F.lit(0), a - margin), F.greatest(F.lit(0), F.least(n.cast("int") - 1, a + margin)))))
    return F.when(n > 0, F.size(F.array_distinct(near)) / n).otherwise(0.0)


def recent_alarm(flags: DataFrame, flag: str, width: int = 3) -> DataFrame:
    """Whether one of the last ``width`` rows was flagged."""
    by = Window.partitionBy("unique_id").orderBy("t").rowsBetween(1 - width, 0)
    return flags.withColumn(f"{flag}_recent", F.max(flag).over(by))


def exceedance(y: Column, lo: Column, hi: Column) -> Column:
    """1 where the actual lies outside its interval; a missing bound or actual is no exceedance."""
    return F.coalesce(((y < lo) | (y > hi)).cast("int"), F.lit(0))


# -- synthetic breaks and labels -------------------------------------------------------------------


def injected(y: Column, t: Column, tau: Column, kind: Column, delta: Column, n: Column, duration: int = 3, draw: Column | None = None, spread: Column | None = None) -> Column:
    """Value with a break of the given shape from position ``tau`` on; NULL or negative tau leaves it, an unknown shape fails.

    A jump of the variance adds ``draw`` (standard normal, see ``normal_draw``) times |delta| times ``spread``, the
    deviation of the values before the break, or their mean where they do not vary.
    """
    k = t - tau
    rise = F.least(F.lit(1.0), (k + 1) / F.lit(float(duration)))
    during = k < duration
    shape = (
        F.when(kind == "level_shift", y * (1 + delta))
        .when(kind == "slope_change", y * (1 + delta * (k + 1) / F.greatest(n - tau, F.lit(1))))
        .when(kind == "seasonality_change", y * (1 + delta * F.sin(F.lit(math.pi) * k / 6.0)))
        .when(kind == "temporary_drop", F.when(during, y * (1 - F.abs(delta))).otherwise(y))
        .when(kind == "temporary_spike", F.when(during, y * (1 + F.abs(delta))).otherwise(y))
        .when(kind == "gradual_drift", y * (1 + delta * rise))
        .when(kind == "variance_jump", y + F.abs(delta) * spread * draw if draw is not None and spread is not None else F.raise_error(F.lit("variance_jump needs draws and a spread")).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of break: "), F.coalesce(kind, F.lit("NULL")))).cast("double"))
    )
    return F.greatest(F.lit(0.0), F.when(F.coalesce(tau < 0, F.lit(True)) | (t < tau), y).otherwise(shape))


def normal_draw(seed: int, *keys: str) -> Column:
    """Standard normal numbers by a hash of the keys: the same in every run, independent of partitions."""
    u = [(F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30) for k in range(2)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])


def spread_before(y: Column, t: Column, tau: Column, window) -> Column:  # noqa: ANN001
    """Deviation of a series' values before position tau, or their mean if they do not vary."""
    past = F.when(t < tau, y)
    sd = F.stddev_pop(past).over(window)
    return F.greatest(F.when(sd > 0, sd).otherwise(F.avg(past).over(window)), F.lit(1e-9))


def hazard_labels(positions: DataFrame, breaks: DataFrame, horizons: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Whether a break lies within the next h positions, for each h."""
    taus = breaks.where("tau >= 0").groupBy("unique_id").agg(F.collect_set("tau").alias("taus"))
    p = positions.join(taus, "unique_id", "left").withColumn("taus", F.coalesce("taus", F.array().cast("array<bigint>")))

    def soon(h: int) -> Column:
        return F.exists("taus", lambda x: (x > F.col("t")) & (x <= F.col("t") + h)).cast("int").alias(f"z_h{h}")

    return p.select("unique_id", "t", *[soon(h) for h in horizons])


def residual_trajectory(stream: DataFrame, windows: Sequence[int] = (3, 6)) -> DataFrame:
    """Rolling shape of a residual stream and the length of its current sign run."""
    by = Window.partitionBy("unique_id").orderBy("t")
    s = stream.withColumn("up", (F.coalesce(F.col("z"), F.lit(0.0)) > 0).cast("int"))
    s = s.withColumn("turn", (F.col("up") != F.coalesce(F.lag("up").over(by), 1 - F.col("up"))).cast("int")).withColumn("run", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cols = []
    for w in windows:
        frame = by.rowsBetween(1 - w, 0)
        cols += [F.avg("z").over(frame).alias(f"resid_mean_{w}"), F.avg(F.abs("z")).over(frame).alias(f"resid_absmean_{w}"), F.when(F.count("z").over(frame) >= 2, F.stddev_samp("z").over(frame)).alias(f"resid_std_{w}")]
    return s.select("unique_id", "t", "z", *cols, (F.col("z") - F.lag("z").over(by)).alias("resid_trend"), F.row_number().over(Window.partitionBy("unique_id", "run").orderBy("t")).alias("resid_sign_run"))


def interval_width(rows: DataFrame, lo: str, hi: str, point: str) -> DataFrame:
    by = Window.partitionBy("unique_id").orderBy("t")
    w = rows.withColumn("interval_width", (F.col(hi) - F.col(lo)) / F.greatest(F.abs(point), F.lit(1e-9)))
    return w.withColumn("interval_width_change", F.col("interval_width") - F.lag("interval_width").over(by))


def invariant_features(table: DataFrame, features: Sequence[str], tolerance: float = 0.99) -> DataFrame:
    """Features that take at most one value per position in nearly all positions."""
    per = table.groupBy("t").agg(*[F.countDistinct(f).alias(f) for f in features])
    share = per.agg(*[F.avg((F.col(f) <= 1).cast("int")).alias(f) for f in features]).unpivot([], list(features), "feature", "share")
    return share.where(F.col("share") >= tolerance)


# -- scoring ---------------------------------------------------------------------------------------


def detection_delays(alarms: DataFrame, labels: DataFrame) -> DataFrame:
    """Months from the break to the first alarm at or after it, and from the last alarm before it."""
    j = labels.where("tau >= 0").join(alarms, "unique_id", "left").withColumn("alarms", F.coalesce("alarms", F.array().cast("array<int>")))
    after, before = F.array_min(F.filter("alarms", lambda a: a >= F.col("tau"))), F.array_max(F.filter("alarms", lambda a: a < F.col("tau")))
    return j.select("unique_id", "tau", (after - F.col("tau")).alias("delay"), after.isNotNull().alias("detected"), F.array_min("alarms").alias("first_alarm"), (F.col("tau") - before).alias("lead_time"))


def match_within(true: Column, predicted: Column, margin: int) -> Column:
    """Number of true points that find an own prediction: greedy, in order, nearest first."""
    start = F.struct(predicted.alias("left"), F.lit(0).alias("n"))

    def step(s: Column, tau: Column) -> Column:
        near = F.filter(s["left"], lambda p: F.abs(p - tau) <= margin)
        best = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p - tau).alias("d"), p.alias("p"))))
        rest = F.when(best.isNotNull(), F.filter(s["left"], lambda p: p != best["p"])).otherwise(s["left"])
        return F.struct(rest.alias("left"), (s["n"] + F.when(best.isNotNull(), 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sort_array(true), start, step)["n"]


def score(alarms: DataFrame, labels: DataFrame, margin: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and false alarms per series-year of alarms against single-break labels."""
    pairs = labels.join(alarms, "unique_id", "left").withColumn("alarms", F.coalesce("alarms", F.array().cast("array<int>")))
    true = F.when(F.col("tau") >= 0, F.array(F.col("tau").cast("int"))).otherwise(F.array().cast("array<int>"))
    per = pairs.select(*keys, "n_obs", F.size(true).alias("n_true"), F.size("alarms").alias("n_pred"), match_within(true, F.col("alarms"), margin).alias("matched"), F.size(F.filter("alarms", lambda a: (F.col("tau") < 0) | (F.abs(a - F.col("tau")) > margin))).alias("false"))
    s = per.groupBy(*keys).agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("matched").alias("matched"), (F.sum("false") / (F.sum("n_obs") / 12.0)).alias("false_per_year"))
    p, r = F.try_divide("matched", "n_pred"), F.try_divide("matched", "n_true")
    return s.select(*keys, "n_true", "n_pred", "matched", p.alias("precision"), r.alias("recall"), F.when(F.col("matched") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "false_per_year")


def _segments(taus: Column, n: Column) -> Column:
    inner = F.sort_array(F.array_distinct(F.filter(taus, lambda t: (t > 0) & (t < n))))
    bounds = F.concat(F.array(F.lit(0)), inner, F.array(n.cast("int")))
    return F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.struct(F.element_at(bounds, i).alias("a"), F.element_at(bounds, i + 1).alias("b")))


def covering(rows: DataFrame, true: Column, predicted: Column, n: Column) -> DataFrame:
    """Length-weighted best overlap of the true segments with predicted ones, per series."""
    r = rows.withColumn("ts", _segments(true, n)).withColumn("ps", _segments(predicted, n))

    def best(s: Column) -> Column:
        overlap = F.transform("ps", lambda p: F.greatest(F.lit(0), F.least(s["b"], p["b"]) - F.greatest(s["a"], p["a"])) / (F.greatest(s["b"], p["b"]) - F.least(s["a"], p["a"])).cast("double"))
        return (s["b"] - s["a"]) * F.array_max(overlap)

    return r.withColumn("covering", F.aggregate(F.transform("ts", best), F.lit(0.0), lambda a, x: a + x) / n).drop("ts", "ps")


def nearest_rate(rates: DataFrame, target: float) -> DataFrame:
    """The schedule whose false-alarm rate is nearest to a target; ties go to the longer period."""
    return rates.agg(F.max_by(F.struct("period", "rate"), F.struct((-F.abs(F.col("rate") - target)).alias("d"), "period")).alias("r")).select("r.*")


def recall_gap(hits_a: np.ndarray, hits_b: np.ndarray, seed: int = 0, draws: int = 2000) -> tuple[float, float, float]:
    """Recall difference of two detectors on the same breaks, with a paired bootstrap interval."""
    a, b = np.asarray(hits_a, float), np.asarray(hits_b, float)
    pick = np.random.default_rng(seed).integers(0, len(a), (draws, len(a)))
    gaps = a[pick].mean(1) - b[pick].mean(1)
    return float(a.mean() - b.mean()), float(np.quantile(gaps, 0.025)), float(np.quantile(gaps, 0.975))
