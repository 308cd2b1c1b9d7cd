"""Queries read whole tables: nothing is left out by its notation, name or length."""

from pyspark.sql import functions as F

from kronopanel.operators import entities as E
from kronopanel.plans import backtest_queries, entity_queries, panel_queries, report_queries
from kronopanel.plans.inputs import national


def test_root_of_every_name(spark):
    names = {
        "Кунгурский муниципальный район": "кунгурский", "«Кунгурский» МО": "кунгурский", "Заречный": "заречный", "г. Дронобшлеово": "дронобшлеово", "Зареч. м.р-н": "зареч",
        "гopoдcкoй oкpуг Биснулраск": "биснулраск", "Биснулраск  (городской округ)": "биснулраск", "г.о.Озёрск": "озерск", "Городищенский район (рег. 09)": "городищенский", "вн. тер. г. муниципальный округ № 54": "54", "МО": "",
    }
    got = spark.createDataFrame([(n,) for n in names], "n string").withColumn("r", E.name_root(F.col("n"))).collect()
    assert {x.n: x.r for x in got} == names


def test_candidate_regions_reads_names_of_any_form(spark, tmp_path):
    ref = [("Заречный муниципальный район", "10"), ("городской округ Заречный", "11"), ("городской округ Дронобшлеово", "12"), ("Кунгурский район", "13")]
    spark.createDataFrame(ref, "municipal_district_name string, region_code string").write.parquet(f"{tmp_path}/oktmo_reference.parquet")
    raw = ["Заречный", "г. Дронобшлеово", "КУНГУРСКИЙ РАЙОН", "Кунгур", "Нигде", "район", None]
    spark.createDataFrame([(m,) for m in raw], "mo string").write.parquet(f"{tmp_path}/raw_blocks.parquet")
    got = {r.root: (r.n_regions, r.source) for r in entity_queries.candidate_regions(spark, str(tmp_path)).collect()}
    assert got == {"заречный": (2, "exact"), "дронобшлеово": (1, "exact"), "кунгурский": (1, "exact"), "кунгур": (1, "stem"), "нигде": (0, "none"), "": (0, "none")}


def test_national_months_of_every_notation(spark, tmp_path):
    periods = ["2024-01", "2024-02-10", "2024-03-31T00:00:00", "15.04.2024", "2024/05/02", "2024-Q3", "05.2025", "never"]
    rows = [("a", "wages-growth", p, float(i + 1)) for i, p in enumerate(periods)] + [("b", "wages-growth", "01.06.2024", 9.0), ("a", "wages-growth", "20.01.2024", 3.0), ("a", "wages-growth", "21.01.2024", float("nan"))]
    spark.createDataFrame(rows, "series_key string, slug string, period string, value double").write.parquet(f"{tmp_path}/national_series.parquet")
    got = {(r.unique_id, r.ds.isoformat()[:7]): r.y for r in national(spark, str(tmp_path)).collect()}
    assert got == {("a", "2024-01"): 2.0, ("a", "2024-02"): 2.0, ("a", "2024-03"): 3.0, ("a", "2024-04"): 4.0, ("a", "2024-05"): 5.0, ("a", "2024-07"): 6.0, ("a", "2025-05"): 7.0, ("b", "2024-06"): 9.0}
    mom = {(r.unique_id, r.ds.month): r.mom for r in panel_queries.growth_mom_yoy(spark, str(tmp_path)).collect() if r.ds.year == 2024}
    assert mom["a", 4] == 0.3333 and mom["a", 5] == 0.25


def test_unpivot_forecasts_takes_every_horizon(spark, tmp_path):
    rows = [("1__food", "2024-02-01", f"h{h}_2024-01", h, "naive", 1.0 * h, 2.0 * h) for h in (1, 3, 6)] + [("1__food", "2024-03-01", "h1_2024-02", 1, "naive", None, 2.0)]
    spark.createDataFrame(rows, "unique_id string, ds string, fold string, horizon int, model string, y double, y_hat double").write.parquet(f"{tmp_path}/oof_old.parquet")
    got = {(r.fold, r.what): r.amount for r in backtest_queries.unpivot_forecasts(spark, str(tmp_path)).collect()}
    assert got == {(f"h{h}_2024-01", what): v * h for h in (1, 3, 6) for what, v in (("y", 1.0), ("y_hat", 2.0))}


def test_pseudo_labels_are_those_of_the_real_series(spark, tmp_path):
    month = lambda k: f"{2022 + k // 12}-{k % 12 + 1:02d}"
    wave = lambda k: 1000 + 7 * ((k * 5) % 7)
    rows = [(month(k), t, "food", wave(k + t) * (2 if t == 8 and k >= 15 else 1)) for t in range(1, 9) for k in range(24)]
    rows += [(month(k), 100, "food", wave(k) * (2 if k >= 6 else 1)) for k in range(12)]  # too short for the synthetic bench
    spark.createDataFrame(rows, "date string, territory_id int, category string, value int").write.parquet(f"{tmp_path}/consumption.parquet")
    got = {(r.unique_id, r.t) for r in report_queries.pseudo_labels(spark, str(tmp_path)).collect()}
    assert got == {("8__food", 15), ("100__food", 6)}
