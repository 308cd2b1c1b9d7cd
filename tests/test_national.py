import datetime as dt

import pytest
from pyspark.sql import functions as F

from kronopanel.operators import national as N
from kronopanel.sources import files as S


def test_indicators_against_hand_counts(spark):
    d = lambda m, day=1: dt.date(2024, m, day)
    rows = [("spend", "food", d(1), 10.0), ("spend", "food", d(1, 20), 30.0), ("spend", "food", d(3), 40.0), ("spend", None, d(2), 5.0), ("spend", None, d(3), 0.0), ("spend", None, d(4), 2.0)]
    rows += [("rate", "x", d(1), 7.0), ("rate", "x", d(2), float("nan")), ("rate", "x", None, 1.0), ("other", "x", d(1), 1.0), ("weekly", "a b", d(1), 1.0), ("weekly", "a b", d(2), 4.0)]
    r = spark.createDataFrame(rows, "slug string, type string, ds date, value double")
    sources = [N.Indicator("spend", "s", ("type",), "growth"), N.Indicator("rate", "r", (), "level", 7), N.Indicator("weekly", "w", ("type",), "change", 7)]
    got = {(x.source, x.lag, x.feature, x.ds.month): x.value for x in N.indicator_values(r, sources).collect()}
    assert got == {
        ("spend", 35, "s_food_mom", 2): 0.0, ("spend", 35, "s_food_mom", 3): 1.0, ("spend", 35, "s_food_mom", 4): 0.0,  # the last value fills in
        ("spend", 35, "s_none_mom", 3): -1.0, ("rate", 7, "r", 1): 7.0, ("weekly", 7, "w_a_b", 1): 1.0, ("weekly", 7, "w_a_b", 2): 4.0, ("weekly", 7, "w_a_b_accel", 2): 3.0,
    }
    groups = N.national_groups(N.indicator_values(r, sources))
    assert set(groups) == {7, 35} and str(groups[7].where("ds = date'2024-01-01'").first().published_on) == "2024-02-07"
    origins = spark.createDataFrame([(d(2),), (d(3),), (d(12),)], "origin date")
    known = {x.origin.month: x for x in N.national_as_of(groups, origins).collect()}
    # the end of February knows January at a lag of 7 days, and nothing of February
    assert known[2]["nat7__r"] == 7.0 and known[2]["nat7__w_a_b"] == 1.0 and known[3]["nat7__w_a_b"] == 4.0
    assert known[2]["nat35__s_food_mom"] is None and known[12]["nat7__r"] is None
    assert N.indicator_values(r.limit(0), sources).count() == 0 and N.indicator_values(r, []).count() == 0
    with pytest.raises(ValueError, match="mode"):
        N.Indicator("x", "x", (), "sum")


def test_coded_events(spark):
    d = dt.date
    rows = [(d(2024, 1, 3), "01", "14", 5, -1.0, 2.0, 4), (d(2024, 1, 9), "01", "1", 3, 1.0, None, 1), (d(2024, 1, 9), None, "18", 2, 0.0, 1.0, None), (d(2024, 2, 9), "01", "20", 1, 0.0, 1.0, 3), (None, "01", "14", 1, 0.0, 0.0, 4)]
    e = spark.createDataFrame(rows, "date_added date, region_code string, event_root_code string, num_articles int, avg_tone double, goldstein double, quad_class int")
    r = N.coded_event_features(e, cutoff="2024-01-31").collect()
    assert len(r) == 1 and r[0].news_events == 2 and r[0].news_articles == 8 and r[0].news_tone_min == -1.0 and r[0].news_goldstein_mean == 2.0
    assert r[0].news_material_conflict_share == 0.5 and r[0].news_share_protest == 0.5 and r[0].news_share_statements == 0.5
    c = {x.ds.month: x for x in N.coded_event_features(e, level="country").collect()}
    assert c[1].country_news_events == 3 and abs(c[1].country_news_share_violence - 1 / 3) < 1e-12 and c[2].country_news_share_violence == 1.0


def test_columns_by_rule():
    assert N.feature_columns(["unique_id", "lag_1", "y", "target", "origin", "x"]) == ["lag_1", "x"]
    assert N.hazard_feature_columns(["t", "z", "z_h1", "resid"]) == ["z", "resid"]
    assert [N.is_prediction_column(c) for c in ("q_0.1", "y_hat", "model", "y")] == [True, True, True, False]
    assert N.feature_sets({"a": ["x"], "b": ["y", "z"]}, {"A": ["a"], "B": ["a", "b"]}) == {"A": ["x"], "B": ["x", "y", "z"]}
    with pytest.raises(KeyError, match="no block"):
        N.feature_sets({"a": []}, {"A": ["c"]})


def test_covariates_of_future_months(spark):
    p = spark.createDataFrame([("a", dt.date(2024, 1, 1), "food", 1.0), ("b", dt.date(2024, 5, 1), "food", 1.0), ("c", dt.date(2024, 1, 1), "odd", 1.0)], "unique_id string, ds date, category string, y double")
    s = spark.createDataFrame([("food", 4, 1.5)], "category string, month int, index double")
    out = {(r.unique_id, r.ds.month): r for r in N.covariates(N.future_rows(p, "2024-03-01", 2), s).collect()}
    assert set(out) == {("a", 4), ("a", 5), ("c", 4), ("c", 5)}
    assert out["a", 4].seasonal_index == 1.5 and out["a", 5].seasonal_index == out["c", 4].seasonal_index == 1.0 and abs(out["a", 4].month_sin - 0.8660254) < 1e-6


def test_stale_artifacts(tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.txt", "skip.txt"):
        (tmp_path / "in" / n).write_text(n)
    keys = ["file:in/a.txt", "glob:in/*.txt;except=skip.txt"]
    stamp = tmp_path / "x.stamp"
    S.write_stamp(stamp, {k: S.input_digest(k, tmp_path) for k in keys})
    check = lambda: S.stale_artifacts({"x": stamp}, tmp_path)
    assert check() == {}
    (tmp_path / "in" / "skip.txt").write_text("new")
    assert check() == {}
    (tmp_path / "in" / "c.txt").write_text("c")
    assert check() == {"x": [keys[1]]}
    (tmp_path / "in" / "a.txt").unlink()
    assert check() == {"x": keys}
    S.write_stamp(stamp, {"memory": "1"})
    assert check() == {"x": ["stamp"]} and S.stale_artifacts({"y": tmp_path / "none"}, tmp_path) == {"y": ["stamp"]}
