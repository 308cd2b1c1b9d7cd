import importlib.util
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kronopanel.operators import metrics as M
from kronopanel.operators import models as L
from kronopanel.operators.panel import quantile_group


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 6.0)], "y double, f double")
    y, f = F.col("y"), F.col("f")
    r = df.agg(M.mae(y, f).alias("mae"), M.rmse(y, f).alias("rmse"), M.wape(y, f).alias("wape"), M.r2(y, f).alias("r2")).first()
    assert (r.mae, r.rmse, r.wape) == (1.0, pytest.approx(math.sqrt(1.5)), 0.4) and r.r2 == pytest.approx(-0.2)
    p = spark.createDataFrame([(10.0, 8.0, 12.0)], "y double, a double, b double").agg(M.pinball(F.col("y"), F.col("a"), 0.9).alias("a"), M.pinball(F.col("y"), F.col("b"), 0.9).alias("b")).first()
    assert (round(p.a, 6), round(p.b, 6)) == (1.8, 0.2)


def test_statistics_against_known_values():
    assert M.student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert M.student_tail(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert M.sign_test(9, 1) == pytest.approx(0.021484375) and M.sign_test(0, 0) == 1.0
    assert M.chi_square_tail(5.991, 2) == pytest.approx(0.05, abs=1e-4) and M.chi_square_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert M.studentized_range_quantile(3) == pytest.approx(3.314, abs=2e-3)
    stat, p, mean, n = M.diebold_mariano(np.array([1.0, 2, 3, 4]))
    assert (mean, n) == (2.5, 4) and 0 < p < 0.1 and stat > 0


def test_size_groups_equal_quantile_cuts(spark):
    for n in (1, 5, 7, 12, 40):
        got = [r.g for r in spark.range(1, n + 1).select("id", quantile_group(F.col("id"), F.lit(n)).alias("g")).orderBy("id").collect()]
        edges = np.quantile(np.arange(1, n + 1), [0.2, 0.4, 0.6, 0.8])
        assert got == [1 + int((k > edges + 1e-9).sum()) for k in range(1, n + 1)]


def test_simplex_weights_find_the_good_model():
    rng = np.random.default_rng(0)
    y = rng.normal(0, 1, 500)
    x = np.stack([y + rng.normal(0, 0.1, 500), rng.normal(0, 1, 500), y + 3], axis=1)
    w = L.fit_weights(x.T @ x, x.T @ y)
    assert w.sum() == pytest.approx(1) and w[0] > 0.9 and (w >= 0).all()


def test_registry_refuses_unknown_and_repeated_models():
    with pytest.raises(KeyError, match="no model"):
        L.get("none")
    with pytest.raises(ValueError, match="registered"):
        L.register("ets")(lambda: None)


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_text_operators():
    root = Path(importlib.util.find_spec("kronopanel").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+kronopanel\.llm", p.read_text()), p
