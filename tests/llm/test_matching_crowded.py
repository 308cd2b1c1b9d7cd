"""Blocks whose keys are shared by more territories than a bucket may hold."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kronopanel.llm import matching as M


def test_crowded_keys_reach_the_territory_of_every_block(spark):
    rnd = random.Random(5)
    month = lambda k: f"{2023 + k // 12}-{k % 12 + 1:02d}"
    levels = [1000, 1300, 1700, 2200]  # values shared by many, so that run keys are crowded too
    off, raw, want = [], [], set()
    for t in range(1, 41):
        v = [levels[t % 4] * (1.0 if t % 8 < 4 else 1.2 ** (k % 3)) * rnd.choice([1.0, 1.001]) for k in range(24)]
        off += [(month(k), t, "total", int(x)) for k, x in enumerate(v)]
        forms = {"typo": ("Заречнный район", range(24)), "short": ("Зареч. м.р-н", range(24)), "nameless": (None, range(24)), "few": ("Заречнный район", range(4, 8)), "nameless few": (None, range(4, 8)), "two": ("Зареч. м.р-н", (3, 9)), "gaps": ("Заречный", range(0, 24, 2))}
        for i, (name, ks) in enumerate(forms.values()):
            want.add((t * 10 + i, t))
            raw += [(len(raw) + j, t * 10 + i, name, "total", month(k), float(int(v[k]))) for j, k in enumerate(ks)]
    # a misspelt name with its region leads to a territory without figures
    raw.append((10**6, 999, "Заречнный район (рег. 77)", "total", "2023-01", 5.0))
    raw += [(10**6 + k, 999, "Заречнный район (рег. 77)", "total", month(k), 5.0) for k in range(1, 6)]
    want.add((999, 77))
    ref = [(t, f"{t % 7 + 10}000000", "Заречный муниципальный район", str(t % 7 + 10)) for t in range(1, 41)] + [(77, "77000000", "Заречный муниципальный район", "77")]
    reference = spark.createDataFrame(ref, "territory_id int, oktmo string, municipal_district_name string, region_code string").withColumns({"municipal_district_name_short": F.lit(None).cast("string"), "municipal_district_type": F.lit("x")})
    blocks = M._block_rows(spark.createDataFrame(raw, "row_no long, block_id long, mo string, category_15 string, period string, value double"))
    figures = spark.createDataFrame(off, "date string, t long, category string, value long").withColumn("value", F.col("value").cast("double"))
    series = M._series(figures, ["t"], "category", M._month_of("date"), F.col("value"), F.col("value"))
    got = {(r.b, r.t) for r in M.candidate_pairs(blocks, M._with_kin(M._territory_rows(reference)), series, 3, 0).collect()}
    assert want <= got, sorted(want - got)[:20]


def test_keys_go_out_in_bounded_frames_and_values_once_for_all_stems(spark, monkeypatch):
    """A batch of many series is never one frame; a block behind whose key stand many stems writes its values once."""
    months, values = np.arange(24_000, 24_024), np.linspace(900.0, 1500.0, 24)
    batch = pd.DataFrame({"t": range(5000), "category": "total", "m": [months] * 5000, "v": [values] * 5000})
    frames = [len(f) for f in M._territory_value_keys(iter([batch]))]
    assert max(frames) <= M.FRAME + 1000 and sum(frames) == 5000 * (M.VALUE_BANDS + 2 * 22 + len(M.shape_keys("total", months, values)))

    written = {}
    keep = lambda df, label: written.setdefault(label, df.localCheckpoint())
    monkeypatch.setattr(M, "materialize", keep)
    vowels = "аеиоуы"
    ref = [(k * 6 + j, f"{k % 7 + 10}000000", f"Зареч{x}р{c}н муниципальный район", str(k % 7 + 10)) for k, c in enumerate("бвгджзклмпрстфхц") for j, x in enumerate(vowels)]
    reference = spark.createDataFrame(ref, "territory_id int, oktmo string, municipal_district_name string, region_code string").withColumns({"municipal_district_name_short": F.lit(None).cast("string"), "municipal_district_type": F.lit("x")})
    month = lambda k: f"{2023 + k // 12}-{k % 12 + 1:02d}"
    off = [(month(k), r[0], "total", 1000.0 * (1 + r[0] % 5) + 37 * k * (1 + r[0] % 3)) for r in ref for k in range(24)]
    raw = [(t * 24 + k, t, "Зареч. м.р-н", "total", month(k), 1000.0 * (1 + t % 5) + 37 * k * (1 + t % 3)) for t in (7, 40, 90) for k in range(24)]
    blocks = M._block_rows(spark.createDataFrame(raw, "row_no long, block_id long, mo string, category_15 string, period string, value double"))
    series = M._series(spark.createDataFrame(off, "date string, t long, category string, value double"), ["t"], "category", M._month_of("date"), F.col("value"), F.col("value"))
    got = {(r.b, r.t) for r in M.candidate_pairs(blocks, M._with_kin(M._territory_rows(reference)), series, 3, 0).collect()}
    assert {(t, t) for t in (7, 40, 90)} <= got
    assert written["links"].count() >= 3 * 90 and written["linked-keys"].count() <= 3 * (24 * 2 + 42)


def test_pairs_are_scored_in_slices_of_bounded_months():
    """A stray year widens the time axis to thousands of months; medians and shares are those of the common months."""
    first, months = 12 * 1900, 24_000
    m, v = np.array([24_276, 24_277, 24_290]), np.array([100.0, 110.0, 120.0])
    pair = {"b": 1, "t": 2, "wide": True, "mo": "Горский район", "bm": m, "bv": v, "tm": m[1:], "tv": v[1:] * [1.0, 1.04], "names": ["Горский район"], "regions": ["10"], "kin": [{"k": 1, "rk": 1, "s": 1, "rs": 1}]}
    bare = pair | {"b": 3, "tm": None, "tv": None}
    frames = list(M._features(first, months)(iter([pd.DataFrame([pair, bare] * 50)])))
    assert max(map(len, frames)) * months <= M.CELLS_HELD and sum(map(len, frames)) == 100
    out = pd.concat(frames)
    assert set(out.months[out.b == 1]) == {2} and set(out.months[out.b == 3]) == {0}
    assert np.allclose(out.away[out.b == 1], np.log(1.04) / 2) and set(out.away[out.b == 3]) == {1.0}
    assert set(out[f"f{M.AGREE_SHORT}"][out.b == 1]) == {1.0} and set(out[f"f{M.NONE}"][out.b == 3]) == {1.0}
