import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from kronopanel.operators import ablation as A
from kronopanel.operators import models as L

P = "unique_id string, ds date, category string, y double"


def seasonal_panel(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(f"s{u}", dt.date(2022 + t // 12, t % 12 + 1, 1), "food", 1000 * (1 + 0.3 * math.sin(2 * math.pi * (t % 12 + 1) / 12)) * rnd.uniform(0.99, 1.01)) for u in range(15) for t in range(34)]
    return spark.createDataFrame(rows, P)


def test_a_block_that_helps_is_seen_to_help(spark):
    p = seasonal_panel(spark)
    angle = lambda c: 2 * math.pi * F.month(c) / 12
    add = lambda rows: rows.withColumn("s", F.sin(angle("ds")) - F.sin(angle("origin"))).withColumn("noise", F.lit(0.5))
    folds = [(f"f{m}", f"2024-{m:02d}-01", 2) for m in (2, 4, 6)]
    oof = A.ablation_forecasts(p, folds, {"A": [], "B": ["s"], "N": ["noise"]}, add).cache()
    m = {r.model: r for r in A.ablation_matrix(oof, "A").collect()}
    assert m["B"].mae < 0.5 * m["A"].mae and m["A"].delta == 0 and abs(m["N"].delta) < 1e-6 and m["B"].n == 90
    c = A.block_contributions(oof, [("B", "A")]).first()
    assert c.n == 90 and c.folds == 3 and c.better == 3 and c.sign_p == 0.25 and c.stat < -5 and c.p < 0.001
    with pytest.raises(KeyError):
        A.ablation_matrix(oof, "Z")


def test_nothing_after_the_cutoff_enters(spark):
    p = seasonal_panel(spark)
    late = p.withColumn("y", F.when(F.col("ds") > F.lit("2024-04-01").cast("date"), F.col("y") * 50).otherwise(F.col("y")))
    run = lambda d: {(r.unique_id, r.ds): r.y_hat for r in A.ablation_forecasts(d, [("f", "2024-04-01", 2)], {"A": ["lag_1"]}, lambda r: r).collect()}
    assert run(p) == pytest.approx(run(late), rel=1e-9)  # sums of partitions come in any order


def test_tuning_uses_the_months_before_the_cutoff(spark):
    p = seasonal_panel(spark)
    out = A.tune(p, "2024-06-01", 2, [{"trees": 1, "depth": 1}, {"trees": 5, "depth": 3}], L.get("gbt")).collect()
    assert [r.chosen for r in out].count(True) == 1 and min(out, key=lambda r: r.mae).chosen
    spoiled = p.withColumn("y", F.when(F.col("ds") > F.lit("2024-06-01").cast("date"), F.lit(1.0)).otherwise(F.col("y")))
    again = A.tune(spoiled, "2024-06-01", 2, [{"trees": 1, "depth": 1}, {"trees": 5, "depth": 3}], L.get("gbt")).collect()
    assert [r.mae for r in out] == [r.mae for r in again]
