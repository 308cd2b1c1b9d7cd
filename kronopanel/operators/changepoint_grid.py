"""Every detector at every parameter over many series at once.

Series of one length are the rows of a matrix, and each step of a detector is taken for all of them.  The sums run
in the order of the single-series detectors in ``changepoint``, so that the alarms are theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS_HELD = 1_500_000  # numbers of a matrix worked on at a time: series x length x length at most

# -- streams of a series' values -------------------------------------------------------------------


def round_half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as the engine rounds: half up on the decimal text of a number."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    k = np.floor(y + 0.5)
    out = np.where(x < 0, -k, k) / scale
    unsure = np.isfinite(y) & ((np.abs(y - np.floor(y) - 0.5) < np.maximum(1e-6, y * 1e-15)) | (y >= 2.0**51))
    unit = Decimal(1).scaleb(-digits)
    out[unsure] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in x[unsure].tolist()]
    return np.where(np.isfinite(y), out, x)


def _middle(rows: np.ndarray) -> np.ndarray:
    s, n = np.sort(rows, axis=1), rows.shape[1]
    return (s[:, (n - 1) // 2] + s[:, n // 2]) / 2


def causal_z(v: np.ndarray, first: int, center: bool, least: int = 3) -> np.ndarray:
    """``changepoint.causal_zscores`` with 0 where there is none; the history of a series begins at position ``first``."""
    z = np.zeros(v.shape)
    for t in range(first + least, v.shape[1]):
        past = v[:, first:t]
        med = _middle(past)
        scale = _middle(np.abs(past - med[:, None])) * 1.4826
        flat = ~(scale > 0)
        if flat.any():
            p = past[flat]
            mean = p.cumsum(1)[:, -1] / p.shape[1]
            scale[flat] = np.sqrt(((p - mean[:, None]) ** 2).cumsum(1)[:, -1] / p.shape[1])
        z[:, t] = (v[:, t] - (med if center else 0.0)) / np.maximum(scale, 1e-9)
    return z


def residual_stream(y: np.ndarray) -> np.ndarray:
    r = np.concatenate([np.zeros((len(y), 1)), y[:, 1:] - y[:, :-1]], axis=1)
    return round_half_up(causal_z(r, 1, center=False))


def raw_stream(y: np.ndarray) -> np.ndarray:
    return round_half_up(causal_z(y, 0, center=True))


def noise_stream(y: np.ndarray) -> np.ndarray:
    """``changepoint.noise_units``."""
    floor = np.maximum(np.abs(y).max(1), 1.0) * 1e-9
    scale = np.ones(len(y))
    if y.shape[1] > 1:
        d = y[:, 1:] - y[:, :-1]
        mad = _middle(np.abs(d - _middle(d)[:, None]))
        raw = np.where(mad > floor, mad * 1.4826, d.std(1))
        scale = np.where(raw > floor, raw / math.sqrt(2.0), 1.0)
    return (y - _middle(y)[:, None]) / scale[:, None]


STREAMS = {"residual": residual_stream, "raw": raw_stream, "noise units": noise_stream}

# -- detectors: a matrix of series and a list of parameters to one matrix of alarms for each parameter --------


def cusum(x: np.ndarray, thresholds: Sequence[float], drift: float = 0.5) -> list[np.ndarray]:
    out = [np.zeros(x.shape, bool) for _ in thresholds]
    for alarms, threshold in zip(out, thresholds):
        p, n = np.zeros(len(x)), np.zeros(len(x))
        for t in range(x.shape[1]):
            p, n = np.maximum(0.0, p + x[:, t] - drift), np.maximum(0.0, n - x[:, t] - drift)
            alarms[:, t] = hit = np.maximum(p, n) > threshold
            p[hit] = n[hit] = 0.0
    return out


def page_hinkley(x: np.ndarray, thresholds: Sequence[float], delta: float = 0.05) -> list[np.ndarray]:
    out = [np.zeros(x.shape, bool) for _ in thresholds]
    for alarms, threshold in zip(out, thresholds):
        m, c, lo, hi, n = (np.zeros(len(x)) for _ in range(5))
        for t in range(x.shape[1]):
            n = n + 1
            m = m + (x[:, t] - m) / n
            c = c + (x[:, t] - m - delta)
            lo, hi = np.minimum(lo, c), np.maximum(hi, c)
            alarms[:, t] = hit = np.maximum(c - lo, hi - c) > threshold
            for state in (m, c, lo, hi, n):
                state[hit] = 0.0
    return out


def bocpd(x: np.ndarray, drops: Sequence[float], hazard: float = 1 / 12, confirm: int = 2) -> list[np.ndarray]:
    """The run lengths do not depend on ``drop``: they are found once."""
    n = x.shape[1]
    likely, short = np.zeros(x.shape, int), np.zeros(x.shape)
    r = np.arange(n + 1)[:, None]  # run lengths down, series across
    alpha, kappa = 1 + 0.5 * r, 1.0 + r
    lg = np.array([[math.lgamma((d + 1) / 2) - math.lgamma(d / 2)] for d in 2 * alpha[:, 0]])
    mu, beta, log_run = np.zeros((1, len(x))), np.ones((1, len(x))), np.zeros((1, len(x)))
    for t in range(n):
        v, a, k = x[:, t], alpha[: t + 1], kappa[: t + 1]
        df, scale2 = 2 * a, beta * (k + 1) / (a * k)
        pred = lg[: t + 1] - 0.5 * np.log(np.pi * df * scale2) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale2))
        grow = log_run + pred + math.log1p(-hazard)
        new = np.logaddexp.reduce(log_run + pred + math.log(hazard), axis=0)
        log_run = np.concatenate((new[None], grow))
        log_run -= np.logaddexp.reduce(log_run, axis=0)
        beta = np.concatenate((np.ones((1, len(x))), beta + k * (v - mu) ** 2 / (2 * (k + 1))))
        mu = np.concatenate((np.zeros((1, len(x))), (k * mu + v) / (k + 1)))
        likely[:, t], short[:, t] = np.argmax(log_run, axis=0), np.exp(log_run[:3]).sum(0)
    falls = np.zeros(x.shape, bool)
    if n - confirm > 1:
        t = np.arange(1, n - confirm)
        falls[:, t] = likely[:, t] < likely[:, t - 1]
        for k in range(1, confirm + 1):
            falls[:, t] &= likely[:, t + k] == likely[:, t] + k
    out = [np.zeros(x.shape, bool) for _ in drops]
    for alarms, drop in zip(out, drops):
        alarms[:, confirm:] = (falls & (short >= drop))[:, : n - confirm]
    return out


def conformal(x: np.ndarray, limits: Sequence[float], consecutive: int = 2) -> list[np.ndarray]:
    out = [np.zeros(x.shape, bool) for _ in limits]
    for alarms, limit in zip(out, limits):
        run = np.zeros(len(x), int)
        for t in range(x.shape[1]):
            run = np.where(np.abs(x[:, t]) > limit, run + 1, 0)
            alarms[:, t] = hit = run == consecutive
            run[hit] = 0
    return out


def adwin(x: np.ndarray, deltas: Sequence[float], least: int = 3) -> list[np.ndarray]:
    out = [np.zeros(x.shape, bool) for _ in deltas]
    for alarms, delta in zip(out, deltas):
        start = np.zeros(len(x), int)
        for t in range(2 * least - 1, x.shape[1]):
            for first in np.unique(start):
                n = t + 1 - first
                if n < 2 * least:
                    continue
                rows = np.flatnonzero(start == first)
                w = np.ascontiguousarray(x[rows, first : t + 1])
                s = np.cumsum(w, axis=1)
                k = np.arange(least, n - least + 1)
                gap = np.abs(s[:, k - 1] / k - (s[:, -1:] - s[:, k - 1]) / (n - k))
                harmonic = 1 / (1 / k + 1 / (n - k))
                d = math.log(2 * math.log(max(n, 3)) / delta)
                cut = np.sqrt(2 / harmonic * w.var(axis=1)[:, None] * d) + 2 / (3 * harmonic) * d
                over = (gap > cut).any(1)
                start[rows[over]] += k[np.argmax((gap - cut)[over], axis=1)]
                alarms[rows[over], t] = True
    return out


def _squared(x: np.ndarray):  # noqa: ANN202
    """Cost of the segments from all starts to b, and of any segments by rows of ``x``."""
    zero = np.zeros((len(x), 1))
    s, q = np.concatenate((zero, np.cumsum(x, axis=1)), axis=1), np.concatenate((zero, np.cumsum(x * x, axis=1)), axis=1)

    def cost(rows, a, b):  # noqa: ANN001, ANN202
        return q[rows, b] - q[rows, a] - (s[rows, b] - s[rows, a]) ** 2 / (b - a)

    return cost


def _kernel(x: np.ndarray):  # noqa: ANN202
    n = x.shape[1]
    d = (x[:, :, None] - x[:, None, :]) ** 2
    i, j = np.triu_indices(n, 1)
    half = np.where(d[:, i, j] > 0, d[:, i, j], np.inf)  # each distance stands twice in the square
    m = np.isfinite(half).sum(1)
    half.sort(axis=1)
    at = np.arange(len(x))
    width = np.where(m > 0, (half[at, np.maximum(m - 1, 0) // 2] + half[at, np.minimum(m // 2, len(i) - 1)]) / 2, 1.0)
    g = np.zeros((len(x), n + 1, n + 1))
    g[:, 1:, 1:] = np.exp(-d / width[:, None, None]).cumsum(1).cumsum(2)

    def cost(rows, a, b):  # noqa: ANN001, ANN202
        return (b - a) - (g[rows, b, b] - g[rows, a, b] - g[rows, b, a] + g[rows, a, a]) / (b - a)

    return cost


def optimal(x: np.ndarray, penalties: Sequence[float], least: int = 3, kernel: bool = False) -> list[np.ndarray]:
    """Costs do not depend on the penalty: they are found once."""
    n, rows = x.shape[1], np.arange(len(x))
    out = [np.zeros(x.shape, bool) for _ in penalties]
    if n < 2 * least:
        return out
    cost = (_kernel if kernel else _squared)(x)
    state = []
    for penalty in penalties:
        best, alive = np.full((len(x), n + 1), np.inf), np.zeros((len(x), n + 1), bool)
        best[:, 0], alive[:, 0] = -penalty, True
        state.append((penalty, best, alive, np.zeros((len(x), n + 1), int)))
    for b in range(least, n + 1):
        c = cost(rows[:, None], np.arange(b - least + 1)[None], b)
        for penalty, best, alive, last in state:
            ok = alive[:, : b - least + 1]
            total = np.where(ok, best[:, : b - least + 1] + c + penalty, np.inf)
            last[:, b] = k = np.argmin(total, axis=1)
            best[:, b] = total[rows, k]
            ok &= total - penalty <= best[:, b : b + 1]
            alive[:, b] = True
    for alarms, (_, _, _, last) in zip(out, state):
        left, b = rows, np.full(len(x), n)
        while len(left):
            b = last[left, b]
            left, b = left[b > 0], b[b > 0]
            alarms[left, b] = True
    return out


def binary(x: np.ndarray, penalties: Sequence[float], least: int = 3) -> list[np.ndarray]:
    """A segment splits at the same place whatever the penalty: a break counts while it and all splits before it gain more."""
    n = x.shape[1]
    strength = np.full(x.shape, -np.inf)
    if n >= 2 * least:
        cost, k = _squared(x), np.arange(n + 1)[None]
        row, a, b, held = np.arange(len(x)), np.zeros(len(x), int), np.full(len(x), n), np.full(len(x), np.inf)
        while len(row):
            r, lo, hi = row[:, None], a[:, None], b[:, None]
            inside = (k >= lo + least) & (k <= hi - least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(inside, cost(r, lo, hi) - cost(r, lo, k) - cost(r, k, hi), -np.inf)
            at = np.argmax(gain, axis=1)
            held = np.minimum(held, gain[np.arange(len(row)), at])
            keep = held > min(penalties)
            row, a, b, at, held = row[keep], a[keep], b[keep], at[keep], held[keep]
            strength[row, at] = held
            row, a, b, held = np.concatenate((row, row)), np.concatenate((a, at)), np.concatenate((at, b)), np.concatenate((held, held))
            wide = b - a >= 2 * least
            row, a, b, held = row[wide], a[wide], b[wide], held[wide]
    return [strength > p for p in penalties]


def window(x: np.ndarray, penalties: Sequence[float], least: int = 3) -> list[np.ndarray]:
    half, n = max(least, 3), x.shape[1]
    strength = np.full(x.shape, -np.inf)
    if n >= 2 * half:
        cost, rows, k = _squared(x), np.arange(len(x))[:, None], np.arange(half, n - half + 1)[None]
        gain = cost(rows, k - half, k + half) - cost(rows, k - half, k) - cost(rows, k, k + half)
        wide = np.pad(gain, ((0, 0), (least - 1, least - 1)), constant_values=-np.inf)
        top = np.max([wide[:, i : i + gain.shape[1]] for i in range(2 * least - 1)], axis=0)
        strength[:, half : n - half + 1] = np.where(gain == top, gain, -np.inf)
    return [strength > p for p in penalties]


def rbf(x: np.ndarray, penalties: Sequence[float]) -> list[np.ndarray]:
    return optimal(x, penalties, kernel=True)


BATCHED = {"cusum": cusum, "page_hinkley": page_hinkley, "bocpd": bocpd, "adwin": adwin, "conformal": conformal, "pelt_l2": optimal, "pelt_rbf": rbf, "kernel_rbf": rbf, "binseg_l2": binary, "window_l2": window}


def by_length(xs: Sequence) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, matrix)`` of the series of one length, a bounded number at a time."""
    lengths = np.array([len(x) for x in xs], int)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, CELLS_HELD // max(1, n * n))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            yield rows, np.array([xs[j] for j in rows], float).reshape(len(rows), n)


def grid_of(x: np.ndarray, grid: dict[str, Sequence[float]]) -> Iterator[tuple[str, float, np.ndarray]]:
    """``(detector, parameter, alarms)``; detectors that are one function share its results."""
    done: dict = {}
    for name, values in grid.items():
        key = BATCHED[name], tuple(values)
        if key not in done:
            done[key] = BATCHED[name](x, [float(v) for v in values])
        yield from ((name, float(v), alarms) for v, alarms in zip(values, done[key]))


# -- counts ----------------------------------------------------------------------------------------

COUNTS = ("n_true", "n_pred", "matched", "false", "n_obs", "delay", "detected")
_COUNTED = "half int, detector string, parameter double, " + ", ".join(f"{c} long" for c in COUNTS)


def counted(alarms: np.ndarray, tau: np.ndarray, n_obs: np.ndarray, margin: int = 1) -> tuple[int, ...]:
    """Sums over series with at most one break (``tau`` below 0: none): what ``changepoint.score`` and ``delay_curve`` sum."""
    t, broken = np.arange(alarms.shape[1])[None], tau >= 0
    near = alarms & broken[:, None] & (np.abs(t - tau[:, None]) <= margin)
    after = alarms & broken[:, None] & (t >= tau[:, None])
    found = after.any(1)
    delay = np.argmax(after, axis=1)[found] - tau[found]
    return tuple(int(v) for v in (broken.sum(), alarms.sum(), near.any(1).sum(), alarms.sum() - near.sum(), n_obs.sum(), delay.sum(), found.sum()))


def grid_counts(series: DataFrame, grids: dict[str, dict[str, Sequence[float]]], margin: int = 1) -> DataFrame:
    """Counts by half of the series, detector/stream and parameter, in one pass over ``series(unique_id, ys, tau, n_obs)``.

    ``grids`` has the detectors of each of STREAMS.  ``ys`` are a series' values in order, ``half`` is drawn by a hash of its
    name.  A task sums its own series; alarms are not written anywhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, str, float], np.ndarray] = {}
        for pdf in batches:
            halves, taus, lengths = (pdf[c].to_numpy(np.int64) for c in ("half", "tau", "n_obs"))
            for rows, y in by_length(pdf["ys"]):
                for stream, grid in grids.items():
                    for name, parameter, alarms in grid_of(STREAMS[stream](y), grid):
                        for half in (0, 1):
                            own = halves[rows] == half
                            if own.any():
                                key = half, f"{name}/{stream}", parameter
                                sums[key] = sums.get(key, 0) + np.array(counted(alarms[own], taus[rows][own], lengths[rows][own], margin), np.int64)
        if sums:
            yield pd.DataFrame([(*key, *map(int, v)) for key, v in sums.items()], columns=["half", "detector", "parameter", *COUNTS])

    half = F.pmod(F.xxhash64("unique_id"), F.lit(2)).cast("int").alias("half")
    parts = series.select(half, "ys", "tau", "n_obs").mapInPandas(run, _COUNTED)
    return parts.groupBy("half", "detector", "parameter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _scored(counts: DataFrame) -> DataFrame:
    p, r = F.try_divide("matched", "n_pred"), F.try_divide("matched", "n_true")
    f1 = F.when(F.col("matched") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("detector", "parameter", "n_true", "n_pred", "matched", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("false") / (F.col("n_obs") / 12.0)).alias("false_per_year"))


def calibrated_counts(counts: DataFrame) -> DataFrame:
    """``changepoint.calibrated`` from counts."""
    first = _scored(counts.where("half = 0"))
    best = first.groupBy("detector").agg(F.max_by("parameter", F.struct("f1", -F.col("parameter"))).alias("parameter"), F.max("f1").alias("f1_calibration"))
    return _scored(counts.where("half = 1")).join(F.broadcast(best), ["detector", "parameter"])  # a row per detector


def delay_counts(counts: DataFrame) -> DataFrame:
    """``changepoint.delay_curve`` from counts."""
    both = counts.groupBy("detector", "parameter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    late = both.select("detector", "parameter", F.try_divide("delay", "detected").alias("mean_delay"), F.when(F.col("n_true") > 0, F.col("detected")).alias("detected"))
    return _scored(both).join(late, ["detector", "parameter"]).select("detector", "parameter", "false_per_year", "recall", "mean_delay", "detected")
