import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kronopanel.operators import changepoint as C


def test_unknown_kinds_of_break_are_refused(spark):
    df = spark.createDataFrame([(t, 10.0, 2, 6) for t in range(6)], "t int, y double, tau int, n int")
    inject = lambda tau: df.select(C.injected(F.col("y"), F.col("t"), tau, F.lit("swirl"), F.lit(0.5), F.col("n")).alias("v")).collect()
    assert [r.v for r in inject(F.lit(-1))] == [10.0] * 6
    with pytest.raises(PySparkException, match="unknown kind of break: swirl"):
        inject(F.col("tau"))
