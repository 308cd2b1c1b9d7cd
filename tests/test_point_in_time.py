"""Metamorphic tests: deleting or poisoning the future must not change what was known before."""

import datetime as dt
import random

from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date, latest_published_month
from kronopanel.operators import backtest as B
from kronopanel.operators import changepoint as C
from kronopanel.operators import features as X

D = dt.date
CUT = D(2024, 3, 1)


def panel_rows(seed=1, n=6, months=24):
    rnd = random.Random(seed)
    rows = []
    for s in range(n):
        for m in range(months):
            if rnd.random() < 0.9 or m in (0, months - 1):
                rows.append((f"{s}__total", s, "total", D(2023 + m // 12, m % 12 + 1, 1), 1000.0 + 100 * s + 10 * m + rnd.random() * 50))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, territory_id int, category string, ds date, y double")


def poisoned(rows):
    return [(*r[:4], r[4] * 1000) if r[3] > CUT else r for r in rows]


def known(df, time="origin"):
    return sorted(map(str, df.where(F.col(time) <= F.lit(CUT)).collect()))


def test_features_ignore_the_future(spark):
    rows = panel_rows()
    a, b = frame(spark, rows), frame(spark, poisoned(rows))
    assert known(X.lag_features(a)) == known(X.lag_features(b))
    assert known(X.growth(a), "ds") == known(X.growth(b), "ds")
    pairs = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0), (2, 0, 3.0)], "x int, y int, distance double")
    assert known(X.neighbour_features(a, pairs), "ds") == known(X.neighbour_features(b, pairs), "ds")
    monthly = lambda p: p.groupBy("ds").agg(F.avg("y").alias("v"))
    origins = a.select(F.col("ds").alias("origin")).distinct()
    assert known(X.as_of_origin(monthly(a), origins, 0)) == known(X.as_of_origin(monthly(b), origins, 0))


def test_forecasts_ignore_the_future(spark):
    rows = panel_rows()
    folds = B.folds_frame(spark, [B.Fold("h3_2024-03", "2024-03-01", 3)])
    out = [sorted(map(str, B.reference_forecasts(frame(spark, r), folds).collect())) for r in (rows, poisoned(rows))]
    assert out[0] == out[1] and out[0]
    from kronopanel.operators import models as L

    for name in ("ets", "theta", "ar", "trend_season"):
        out = [sorted(map(str, L.get(name)(frame(spark, r), folds).collect())) for r in (rows, poisoned(rows))]
        assert out[0] == out[1] and len(out[0]) == 18


def test_events_are_invisible_until_published(spark):
    e = [(1, D(2024, 1, 10), D(2024, 3, 5), "01", "flood"), (2, D(2024, 2, 1), D(2024, 2, 1), "all", "rate"), (3, D(2024, 5, 1), D(2024, 1, 1), "01", "holiday")]
    ev = spark.createDataFrame(e, "event_id long, date date, published_at date, region_code string, kind string")
    grid = spark.createDataFrame([("01",), ("02",)], "region_code string").crossJoin(X.month_spine(spark, "2024-01-01", "2024-06-01").withColumnRenamed("ds", "origin"))
    got = {(r.region_code, str(r.origin)[:7], r.kind): (r.flag, round(r.trace, 4)) for r in X.events_as_of(ev, grid).collect()}
    assert ("01", "2024-01", "flood") not in got and ("01", "2024-02", "flood") not in got
    assert got["01", "2024-03", "flood"] == (0, 0.25)
    assert got["02", "2024-02", "rate"] == (1, 1.0) and got["02", "2024-04", "rate"] == (0, 0.25)
    assert ("01", "2024-04", "holiday") not in got and got["01", "2024-05", "holiday"] == (1, 1.0)


def test_published_month_closed_form(spark):
    rows = [(D(2023, 1, 1) + dt.timedelta(31 * k), lag) for k in range(18) for lag in (0, 1, 7, 28, 30, 31, 35, 45, 60, 92)]
    df = spark.createDataFrame(rows, "o date, lag int").withColumn("o", F.trunc("o", "MM")).withColumn("m", latest_published_month(F.col("o"), F.col("lag"))).withColumn("end", F.last_day("o"))
    ok = (F.date_add(F.last_day("m"), F.col("lag")) <= F.col("end")) & (F.date_add(F.last_day(F.add_months("m", 1)), F.col("lag")) > F.col("end"))
    assert df.where(~ok).count() == 0


def test_date_notations(spark):
    rows = ["2023-02-05", " 2023-02-05T21:00:00", "05.02.2023", "2023/02/05", "2023-02", "02.2023", "2023-Q2", "2023Q4", "soon", "", None, "2023-13-01", "32.01.2023"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [str(r.d) for r in df.select("i", flexible_date(F.col("s")).alias("d")).orderBy("i").collect()]
    assert got == ["2023-02-05"] * 4 + ["2023-02-01"] * 2 + ["2023-04-01", "2023-10-01"] + ["None"] * 5


def test_detectors_are_causal(spark):
    rnd = random.Random(7)
    rows = [(f"s{s}", t, rnd.gauss(0, 1) + (3 if t > 30 else 0)) for s in range(4) for t in range(60)]
    df = lambda n: spark.createDataFrame([r for r in rows if r[1] < n], "unique_id string, t int, x double")
    for f in (lambda a: C.cusum_alarms(a, 5.0), lambda a: C.page_hinkley_alarms(a, 5.0), lambda a: C.detect(a, "bocpd", 0.3), lambda a: C.detect(a, "adwin", 0.05)):
        whole, part = ({r.unique_id: r.alarms for r in f(C.series_arrays(df(n), "x")).collect()} for n in (60, 41))
        assert {k: [t for t in v if t < 41] for k, v in whole.items()} == part
    z = lambda n: {(r.unique_id, r.t): r.z for r in C.causal_zscores(df(n), "x", center=True).collect()}
    a, b = z(60), z(41)
    assert all(a[k] == v for k, v in b.items())
