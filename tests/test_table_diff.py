from pyspark.sql import functions as F

from kronopanel.operators.table_diff import diff_copies

S = "k1 string, k2 int, x double, s string, presence string"


def run(spark, left, right):
    df = diff_copies(spark.createDataFrame(left, S), spark.createDataFrame(right, S), ["k1", "k2"], ["x", "s"], tolerance=0.01)
    return {(r.k1, r.k2): (r.presence, [(d.field, d.left_value, d.right_value) for d in r.differences], r.conflicting) for r in df.collect()}


def test_missing_and_differing_rows(spark):
    nan = float("nan")
    left = [("a", 1, 1.0, "p", "z")] * 3 + [("b", 1, nan, "p", ""), ("c", 1, 5.0, None, ""), ("d", 1, 1.0, "p", ""), (None, None, 1.0, "p", "")]
    right = [("a", 1, 1.005, "p", "other"), ("b", 1, None, "p", ""), ("c", 1, 5.02, "q", ""), ("e", 1, 1.0, "p", ""), (None, None, None, "p", "")]
    assert run(spark, left, right) == {
        ("c", 1): ("both", [("x", "5.0", "5.02"), ("s", None, "q")], False),
        ("d", 1): ("left_only", [], False),
        ("e", 1): ("right_only", [], False),
        (None, None): ("both", [("x", "1.0", None)], False),
    }


def test_conflicting_rows_of_one_copy_are_marked(spark):
    out = run(spark, [("a", 1, 1.0, "p", ""), ("a", 1, 2.0, "p", "")], [("a", 1, 2.0, "p", "")])
    assert out == {("a", 1): ("both", [("x", "1.0", "2.0")], True)}


def test_infinite_values_and_empty_tables(spark):
    inf = float("inf")
    assert run(spark, [("a", 1, inf, "p", "")], [("a", 1, inf, "p", "")]) == {}
    assert run(spark, [("a", 1, inf, "p", "")], [("a", 1, -inf, "p", "")])[("a", 1)][0] == "both"
    assert run(spark, [], []) == {}
    assert run(spark, [], [("a", 1, 1.0, "p", "")])[("a", 1)][0] == "right_only"


def test_long_and_decimal_numbers_compare_exactly(spark):
    big = 2**53
    a = spark.createDataFrame([(1, big), (2, big), (3, None)], "k int, v long")
    b = spark.createDataFrame([(1, big + 1), (2, big), (3, 5)], "k int, v long")
    assert {r.k for r in diff_copies(a, b, ["k"], ["v"]).collect()} == {1, 3}
    da, db = (d.selectExpr("k", "cast(v as decimal(30,4)) + 0.0001 as v") for d in (a, b))
    assert {r.k for r in diff_copies(da, db, ["k"], ["v"]).collect()} == {1, 3}
    assert {r.k for r in diff_copies(a, db, ["k"], ["v"]).collect()} == {1, 3}
    assert {r.k for r in diff_copies(a, b.withColumn("v", F.col("v").cast("double")), ["k"], ["v"]).collect()} == {3}  # a double holds no more
