import datetime as dt
import io
import itertools
import random
import zipfile
from dataclasses import dataclass, field

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronopanel.operators import entities as E
from kronopanel.operators import panel as P
from kronopanel.operators.features import Block, join_blocks
from kronopanel.sources import files as S


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 6)):
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        to = E.assign(c)
        assert len(set(to.tolist())) == n and sum(c[i, to[i]] for i in range(n)) == pytest.approx(best)


def test_blocks_do_not_depend_on_shards(spark):
    rnd = random.Random(2)
    rows, period = [], 0
    for i in range(300):
        period = rnd.choice([period + 1, period + 1, period + 1, 0])
        rows.append((i, rnd.choice(["a", "a", "a", None]), f"{period:04d}" if rnd.random() < 0.95 else None))
    want, block, prev = {}, 0, None
    for i, k, p in rows:
        if prev is None or prev[0] != k or not (p is not None and prev[1] is not None and p > prev[1]):
            block += 1
        want[i], prev = block, (k, p)
    df = spark.createDataFrame(rows, "n long, k string, p string")
    for size in (7, 50, 1000):
        got = {r.n: r.block for r in E.series_blocks(df, "n", ["k"], "p", F.floor(F.col("n") / size)).collect()}
        assert got == want


def test_viterbi_bridges_a_stray_candidate():
    path = E.smooth_path([{"a"}, {"a"}, set(), {"a"}, {"b"}, {"b"}, {"b"}], ["a", "b"])
    assert path == ["a"] * 4 + ["b"] * 3


def test_contract_names_what_is_broken(spark):
    ok = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 2, 1), 2.0)]
    schema = "unique_id string, ds date, y double"
    assert P.validate_panel(spark.createDataFrame(ok, schema)).count() == 2
    for bad, rule in ((("a", dt.date(2024, 1, 1), 3.0), "duplicate_keys"), (("b", dt.date(2024, 1, 1), -1.0), "negative"), (("b", dt.date(2024, 1, 1), None), "nulls"), (("b", dt.date(2024, 1, 2), 1.0), "not_month_start"), (("b", dt.date(2024, 1, 1), float("nan")), "not_finite")):
        with pytest.raises(P.ContractError, match=rule):
            P.validate_panel(spark.createDataFrame([*ok, bad], schema))


def test_blocks_of_features_reject_clashes(spark):
    rows = spark.createDataFrame([("a", 1, 2)], "unique_id string, origin int, x int")
    with pytest.raises(ValueError, match="kind"):
        Block("b", rows, "future")
    with pytest.raises(ValueError, match="exist already"):
        join_blocks(rows, [Block("b", rows, "past_only", ("unique_id",))])
    extra = spark.createDataFrame([("a", 1, 5)], "unique_id string, origin int, z int")
    assert join_blocks(rows, [Block("b", extra, "past_only", ("unique_id",))]).first().z == 5


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheets(spark):
    w = workbook()
    assert S.sheet_names(w) == ["one", "two"]
    assert S.read_sheet(w, "one") == [["name", None, "7"], [], [None, "x"]]
    assert S.read_sheet(w, "two") == [["ab"]]
    with pytest.raises(KeyError):
        S.read_sheet(w, "three")
    assert S.sheet_frame(spark, S.read_sheet(w, "one"), ["a", "b"]).count() == 3


def test_event_days_filter_and_types(spark, tmp_path):
    line = lambda country, day, tone: "\t".join({1: day, 28: "14", 29: "4", 34: tone, 51: country, 53: "59.9", 56: day, 57: "http://x"}.get(i, "") for i in range(58))
    with zipfile.ZipFile(tmp_path / "20240101.zip", "w") as z:
        z.writestr("20240101.csv", "\n".join([line("RS", "20240101", "-1.5"), line("US", "20240101", "2"), line("RS", "bad", "x"), "short"]))
    rows = S.read_event_days(spark, str(tmp_path / "*.zip"), "RS").orderBy("avg_tone").collect()
    assert [(str(r.sqldate), r.quad_class, r.avg_tone, r.country, r.lat, str(r.date_added), r.source_url) for r in rows] == [("None", 4, None, "RS", 59.9, "None", "http://x"), ("2024-01-01", 4, -1.5, "RS", 59.9, "2024-01-01", "http://x")]


def test_manifests_and_stamps(spark, tmp_path):
    for k in range(2):
        spark.range(5).coalesce(1).toPandas().to_parquet(tmp_path / f"m{k}.parquet")
    files = S.build_manifest(tmp_path)
    assert S.manifest_problems(tmp_path, files) == [] and S.load_archive(spark, tmp_path, files).count() == 10
    spark.range(6).toPandas().to_parquet(tmp_path / "m0.parquet")
    with pytest.raises(S.ArchiveMismatch):
        S.load_archive(spark, tmp_path, files)
    (tmp_path / "m1.parquet").unlink()
    with pytest.raises(S.ArchiveAbsent):
        S.load_archive(spark, tmp_path, files)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "m0.parquet", "inner/x.parquet")
    assert S.read_zipped_parquet(spark, str(tmp_path / "a.zip"), "inner/x.parquet").count() == 6
    a = S.frame_digest(spark.range(100).repartition(7))
    assert a == S.frame_digest(spark.range(100)) != S.frame_digest(spark.range(101))
    S.write_stamp(tmp_path / "s.json", {"a": "1", "b": "2"})
    assert S.stale_inputs(tmp_path / "s.json", {"a": "1", "b": "3", "c": "4"}) == ["b", "c"]
    assert S.stale_inputs(tmp_path / "none.json", {"a": "1"}) == ["a"]


@dataclass(frozen=True)
class _Inner:
    name: str
    rate: float = 0.5


@dataclass(frozen=True)
class _Config:
    inner: _Inner
    items: tuple[int, ...] = field(default_factory=tuple)


def test_strict_configuration():
    assert S.from_mapping(_Config, {"inner": {"name": "a", "rate": 1}, "items": [1, 2]}) == _Config(_Inner("a", 1.0), (1, 2))
    for bad, where in (({"inner": {"name": "a", "x": 1}}, "inner: unknown"), ({"inner": {}}, "inner.name: missing"), ({"inner": {"name": 3}}, "inner.name"), ({"inner": {"name": "a"}, "items": [True]}, r"items\[0\]")):
        with pytest.raises(S.ConfigError, match=where):
            S.from_mapping(_Config, bad)


def test_bulletin_levels_and_region_fill(spark):
    rows = [["45000000000", "Region", "1 000"], ["45001000000", "District", "600"], [None, "note", None], ["45001101001", "Town", "x"]]
    got = [(r.level, r.region, r.value) for r in S.parse_bulletin(S.sheet_frame(spark, rows, ["code", "name", "value"]), "code", "name", "value").orderBy("row_no").collect()]
    assert got == [("region", "45", 1000), ("district", "45", 600), ("none", "45", None), ("settlement", "45", None)]
