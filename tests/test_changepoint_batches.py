"""Detectors over matrices of series against the single-series ones."""

import time

import numpy as np
from pyspark.sql import functions as F

from kronopanel.operators import changepoint as C
from kronopanel.operators import changepoint_grid as G

GRID = {"bocpd": (0.15, 0.25, 0.5), "adwin": (0.05, 0.0005), "conformal": (1.5, 2.5), "pelt_l2": (3, 30, 300), "pelt_rbf": (1, 3, 10), "kernel_rbf": (1, 3), "binseg_l2": (3, 30, 300), "window_l2": (3, 30)}


def _series(n, length, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, length)) + np.where(np.arange(length) >= rng.integers(0, length + 1, (n, 1)), rng.choice([0.0, 2.0, 8.0], (n, 1)), 0.0)
    x[: n // 5] = np.round(x[: n // 5])  # equal values, ties
    x[0] = 5.0
    return x


def test_batches_equal_single_series():
    for length in (1, 2, 3, 5, 6, 7, 20, 24, 40):
        x = _series(60, length, length)
        for name, parameter, alarms in G.grid_of(x, GRID):
            assert [np.flatnonzero(a).tolist() for a in alarms] == [list(map(int, C.DETECTORS[name](row, parameter))) for row in x], (name, parameter, length)


def test_batches_take_a_fraction_of_the_time_of_single_series():
    x = _series(1000, 24)
    list(G.grid_of(x[:50], GRID))
    began = time.process_time()
    list(G.grid_of(x, GRID))
    batch = (time.process_time() - began) / len(x)
    began = time.process_time()
    for row in x[:50]:
        for name, values in GRID.items():
            for v in values:
                C.DETECTORS[name](row, v)
    assert batch < (time.process_time() - began) / 50 / 4


def _panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate([4, 5, 20, 21, 24, 24, 24, 24] * 8):
        y = np.round(100 + rng.normal(0, 6, n)) if k % 5 else np.where(np.arange(n) < n // 2, 70.0, 70.0 + k)
        tau = -1 if k % 3 == 0 else min(n - 1, 12)
        rows += [(f"s{k}", t, n, tau, float(v + (40.0 if 0 <= tau <= t else 0.0))) for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "unique_id string, t int, n int, tau int, y double")


def _arrays(stream, value="x"):
    return C.series_arrays(stream.withColumn("x", F.round(F.coalesce(F.col(value), F.lit(0.0)), 6) if value == "z" else F.col(value)), "x")


def _old_and_new(spark):
    p = _panel(spark)
    r = C.naive_residuals(p.withColumn("ds", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t")))).withColumnRenamed("residual", "r")
    streams = {"residual": _arrays(C.causal_zscores(r, "r", center=False), "z"), "raw": _arrays(C.causal_zscores(p, "y", center=True), "z"), "noise units": _arrays(C.noise_units(p))}
    grids = {"residual": {"cusum": (2, 8), "page_hinkley": (3, 12), "bocpd": (0.25,)}, "raw": {"cusum": (3,), "page_hinkley": (5,), "adwin": (0.05,)}, "noise units": {"pelt_l2": (10, 100), "binseg_l2": (10,)}}
    alarms = None
    for name, arrays in streams.items():
        a = C.grid_alarms(arrays, grids[name]).withColumn("detector", F.concat_ws("/", "detector", F.lit(name)))
        alarms = a if alarms is None else alarms.unionByName(a)
    labels = p.groupBy("unique_id").agg(F.max("tau").alias("tau"), F.max("n").alias("n_obs"))
    ys = F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("ys")
    series = p.groupBy("unique_id").agg(ys, F.max("tau").alias("tau"), F.max("n").alias("n_obs"))
    return streams, alarms.cache(), labels, series, G.grid_counts(series, grids).cache()


def test_streams_and_calibration_from_counts(spark):
    streams, alarms, labels, series, counts = _old_and_new(spark)
    values = {r.unique_id: np.array([r.ys]) for r in series.collect()}
    for name, arrays in streams.items():
        for r in arrays.collect():
            got, want = G.STREAMS[name](values[r.unique_id])[0], [v.x for v in r.xs]
            assert np.allclose(got, want, rtol=1e-12, atol=0) if name == "noise units" else got.tolist() == want, (name, r.unique_id)
    want = {(r.detector, r.parameter): r.asDict() for r in C.calibrated(alarms, labels).collect()}
    got = {(r.detector, r.parameter): r.asDict() for r in G.calibrated_counts(counts).collect()}
    assert len(want) == 8 and got == want


def test_delay_curve_from_counts(spark):
    _, alarms, labels, series, counts = _old_and_new(spark)
    want = {(r.detector, r.parameter): r.asDict() for r in C.delay_curve(alarms, labels).collect()}
    got = {(r.detector, r.parameter): r.asDict() for r in G.delay_counts(counts).collect()}
    assert len(want) == 11 and got == want
    unbroken = G.grid_counts(series.where("tau < 0"), {"raw": {"cusum": (3,)}})
    assert [(r.recall, r.mean_delay, r.detected) for r in G.delay_counts(unbroken).collect()] == [(None, None, None)]
    assert G.delay_counts(G.grid_counts(series.where("false"), {"raw": {"cusum": (3,)}})).collect() == []


def test_rounding_is_that_of_the_engine(spark):
    x = np.array([0.0078125, -0.0078125, 1.0000005, 2.5e-7, 1e-9, 0.1234565, 5e11 + 0.3, 123456789012.123456, 1e300, 0.0, -1.4999995, 3.1])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert G.round_half_up(x).tolist() == [r[0] for r in df.select(F.round("x", 6)).collect()]
