import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kronopanel.operators import changepoint as C


def slow_run_lengths(x, hazard):
    """Posterior of the run length, straight from the definition: every run's evidence by its own parameters."""
    n = len(x)
    p = [1.0]
    likely, short = [], []
    for t in range(n):
        new = [0.0] * (len(p) + 1)
        for r, mass in enumerate(p):
            run = x[t - r : t]
            mu, kappa, alpha, beta = 0.0, 1.0, 1.0, 1.0
            for v in run:
                beta += kappa * (v - mu) ** 2 / (2 * (kappa + 1))
                mu = (kappa * mu + v) / (kappa + 1)
                kappa, alpha = kappa + 1, alpha + 0.5
            df, s = 2 * alpha, math.sqrt(beta * (kappa + 1) / (alpha * kappa))
            z = (x[t] - mu) / s
            pred = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi) / s * (1 + z * z / df) ** (-(df + 1) / 2)
            new[r + 1] += mass * pred * (1 - hazard)
            new[0] += mass * pred * hazard
        total = sum(new)
        p = [v / total for v in new]
        likely.append(max(range(len(p)), key=lambda r: p[r]))
        short.append(sum(p[:3]))
    return likely, short


def test_run_lengths_and_confirmed_alarms():
    rnd = random.Random(3)
    for shift in (0.0, 4.0, 8.0):
        x = [rnd.gauss(0, 1) for _ in range(14)] + [rnd.gauss(shift, 1) for _ in range(12)]
        likely, short = slow_run_lengths(x, 1 / 12)
        a, b = C.run_lengths(np.array(x))
        assert a.tolist() == likely and np.allclose(b, short)
        want = []
        for t in range(1, len(x) - 2):
            if likely[t] < likely[t - 1] and short[t] >= 0.25 and likely[t + 1] == likely[t] + 1 and likely[t + 2] == likely[t] + 2:
                want.append(t + 2)
        assert C.bocpd(np.array(x)) == want
    assert any(15 <= t <= 20 for t in C.bocpd(np.array([0.1, -0.1] * 8 + [9.0, 9.1] * 5)))
    assert C.bocpd(np.zeros(0)) == [] and C.bocpd(np.ones(2)) == []


def test_variance_jump_and_unknown_shapes(spark):
    own = Window.partitionBy("unique_id")
    p = spark.range(400).select(F.lit("a").alias("unique_id"), F.col("id").cast("int").alias("t"), (F.lit(100.0) + F.col("id") % 3).alias("y"))
    p = p.unionByName(p.withColumn("unique_id", F.lit("flat")).withColumn("y", F.lit(50.0)))
    p = p.withColumn("spread", C.spread_before(F.col("y"), F.col("t"), F.lit(200), own)).withColumn("draw", C.normal_draw(1, "unique_id", "t"))
    out = p.withColumn("z", C.injected(F.col("y"), F.col("t"), F.lit(200), F.lit("variance_jump"), F.lit(5.0), F.lit(400), draw=F.col("draw"), spread=F.col("spread"))).toPandas()
    for name, usual in (("a", math.sqrt(2 / 3)), ("flat", 50.0)):
        g = out[out.unique_id == name].sort_values("t")
        assert (g.z[:200] == g.y[:200]).all() and (g.z >= 0).all()
        assert name == "flat" or abs((g.z - g.y)[200:].std() / (5 * usual) - 1) < 0.15
    draws = out.draw.to_numpy()
    assert abs(draws.mean()) < 0.1 and abs(draws.std() - 1) < 0.1
    with pytest.raises(Exception, match="unknown kind of break"):
        p.select(C.injected(F.col("y"), F.col("t"), F.lit(2), F.lit("swirl"), F.lit(0.1), F.lit(4))).collect()


def test_grid_equals_single_runs_and_halves_are_apart(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for k in range(60):
        tau = -1 if k % 3 == 0 else 12
        rows += [(f"s{k}", t, rnd.gauss(0, 1) + (5.0 if 0 <= tau <= t else 0.0)) for t in range(24)]
        labels.append((f"s{k}", tau, 24))
    arrays = C.series_arrays(spark.createDataFrame(rows, "unique_id string, t int, x double"), "x").cache()
    lab = spark.createDataFrame(labels, "unique_id string, tau int, n_obs int")
    grid = C.grid_alarms(arrays, {"cusum": (3, 8), "page_hinkley": (5,), "conformal": (2.0,), "pelt_l2": (10, 1000)})
    got = {(r.unique_id, r.detector, r.parameter): r.alarms for r in grid.collect()}
    assert len(got) == 60 * 6
    for name, parameter, one in (("cusum", 8.0, C.cusum_alarms(arrays, 8.0)), ("page_hinkley", 5.0, C.page_hinkley_alarms(arrays, 5.0)), ("pelt_l2", 10.0, C.detect(arrays, "pelt_l2", 10.0))):
        assert all(got[r.unique_id, name, parameter] == r.alarms for r in one.collect())
    best = {r.detector: r for r in C.calibrated(grid, lab).collect()}
    assert set(best) == {"cusum", "page_hinkley", "conformal", "pelt_l2"} and best["pelt_l2"].parameter == 10.0 and best["pelt_l2"].f1 > 0.8
    test_half = lab.where(F.pmod(F.xxhash64("unique_id"), F.lit(2)) == 1).where("tau >= 0").count()
    assert all(r.n_true == test_half for r in best.values())
    curve = {(r.detector, r.parameter): r for r in C.delay_curve(grid, lab).collect()}
    assert curve["pelt_l2", 10.0].mean_delay < 2 and curve["pelt_l2", 1000.0].detected == 0


def test_coverage_of_windows(spark):
    df = spark.createDataFrame([([0, 5, 6], 10), ([], 10), ([9], 10), ([], 0)], "alarms array<int>, n int")
    assert [r[0] for r in df.select(C.window_coverage(F.col("alarms"), F.col("n"), 1)).collect()] == [0.6, 0.0, 0.2, 0.0]
