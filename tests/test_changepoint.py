import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronopanel.operators import changepoint as C
from kronopanel.streaming.detectors import stream_alarms


def test_matching_is_greedy_and_one_to_one(spark):
    rows = [([5, 6], [6]), ([5, 10], [4, 6, 11]), ([], [3]), ([3], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    assert [r.m for r in df.select(C.match_within(F.col("a"), F.col("b"), 1).alias("m")).collect()] == [1, 2, 0, 0]


def test_covering(spark):
    df = spark.createDataFrame([([5], [5], 10), ([5], [], 10), ([-1], [5], 10)], "a array<int>, b array<int>, n int")
    got = [round(r.covering, 4) for r in C.covering(df, F.col("a"), F.col("b"), F.col("n")).collect()]
    assert got == [1.0, 0.5, 0.5]


def test_injected_shapes(spark):
    df = spark.createDataFrame([(100.0, t, 12) for t in range(24)], "y double, t int, tau int")
    get = lambda kind, delta: [round(r.v, 4) for r in df.select("t", C.injected(F.col("y"), F.col("t"), F.col("tau"), F.lit(kind), F.lit(delta), F.lit(24)).alias("v")).orderBy("t").collect()]
    assert get("level_shift", 0.25) == [100.0] * 12 + [125.0] * 12
    assert get("temporary_drop", 0.5) == [100.0] * 12 + [50.0] * 3 + [100.0] * 9
    assert get("gradual_drift", 0.3)[12:16] == [110.0, 120.0, 130.0, 130.0]


def brute_segmentation(x, penalty, least=3):
    best = {0: (-penalty, [])}
    for b in range(least, len(x) + 1):
        options = [(best[a][0] + ((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty, best[a][1] + ([a] if a else [])) for a in best if b - a >= least]
        if options:
            best[b] = min(options, key=lambda o: o[0])
    return best[len(x)][1]


def test_offline_detectors():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = np.concatenate([rng.normal(0, 1, 12), rng.normal(rng.choice([0, 4]), 1, 12), rng.normal(0, 1, 9)])
        assert C.optimal_breaks(x, 6.0) == brute_segmentation(x, 6.0)
    x = np.concatenate([np.zeros(12), np.full(12, 10.0)]) + rng.normal(0, 0.1, 24)
    for f in (lambda: C.optimal_breaks(x, 3.0), lambda: C.optimal_breaks(x, 1.0, kernel=True), lambda: C.binary_breaks(x, 3.0), lambda: C.window_breaks(x, 3.0)):
        assert f() == [12]
    assert C.optimal_breaks(x[:4], 3.0) == []
    assert any(12 <= t <= 15 for t in C.bocpd(x, drop=0.3))
    long = np.concatenate([np.zeros(60), np.full(60, 3.0)]) + rng.normal(0, 0.1, 120)
    assert any(60 <= t <= 70 for t in C.adwin(long))


def test_bootstrap_interval_holds_the_difference():
    a, b = np.array([1] * 60 + [0] * 40), np.array([1] * 40 + [0] * 60)
    gap, lo, hi = C.recall_gap(a, b)
    assert gap == pytest.approx(0.2) and lo < 0.2 < hi


def test_stream_equals_batch_over_several_batches_and_late_rows(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(days=t), round(rnd.gauss(0, 1) + (2 if t > 25 else 0), 6), t) for s in range(3) for t in range(50)]
    batch = C.series_arrays(spark.createDataFrame(rows, "unique_id string, ts timestamp, x double, t int"), "x")
    want = {("cusum", r.unique_id, t) for r in C.cusum_alarms(batch, 5.0).collect() for t in r.alarms}
    want |= {("page_hinkley", r.unique_id, t) for r in C.page_hinkley_alarms(batch, 5.0).collect() for t in r.alarms}
    shuffled = sorted(rows, key=lambda r: r[3] + rnd.random() * 3)  # up to three days out of order
    shuffled.append(("~end", dt.datetime(2100, 1, 1), 0.0, 0))
    for k in range(0, len(shuffled), 40):
        part = spark.createDataFrame([r[:3] for r in shuffled[k : k + 40]], "unique_id string, ts timestamp, x double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unique_id string, ts timestamp, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_alarms(stream, delay="5 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("unique_id string, ts timestamp, kind string, statistic double").parquet(str(tmp_path / "out")).collect()
    got = [(r.kind, r.unique_id, (r.ts - dt.datetime(2024, 1, 1)).days) for r in out if r.unique_id != "~end"]
    assert len(got) == len(set(got)) and set(got) == want
