import random

import numpy as np

from kronopanel.llm.matching import FEATURES, edit_distance, fit_matcher, likeness, match_blocks, minhash_keys, parse_name, stem

RAW = "row_no long, block_id long, mo string, category_15 string, period string, value double, t string, names string"
REF = "territory_id int, oktmo string, municipal_district_name string, municipal_district_name_short string, municipal_district_type string, year_from int, year_to int, region_code string, b string"
OFF = "date string, territory_id int, category string, value int, m string"


def world(n=120, seed=1):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice(["бар", "вет", "гор", "дун", "зал", "кор", "лим", "мур", "нов", "пес", "рад", "сел", "тюр", "фен", "хор", "чел"]) for _ in range(3))
    ref, off, raw, true, row = [], [], [], {}, 0
    names = {}
    for t in range(1, n + 1):
        common = t % 8 == 0
        names[t] = "Заречный муниципальный район" if common else f"{part().capitalize()}ский муниципальный округ"
        ref.append((t, f"{t % 40 + 10}000{t:03d}", names[t], None, "x", 2000, 9999, str(t % 40 + 10), "x"))
        level, season = 10 ** rnd.uniform(3, 4.5), [rnd.uniform(0.8, 1.2) for _ in range(24)]
        values = [int(level * s) for s in season]
        months = [f"{2023 + k // 12}-{k % 12 + 1:02d}" for k in range(24)]
        if t % 10 != 1:
            off += [(m, t, "total", v, "x") for m, v in zip(months, values)]
        for copy in range(2):
            kind = rnd.choice(["exact", "typo", "unit", "noise", "null", "decoy"])
            if t % 10 == 1:
                kind = "exact" if not common else "decoy"
            name, v = names[t], [float(x) for x in values]
            if kind == "typo" and not common:
                name = name[:4] + name[5:]
            elif kind == "unit":
                v = [x / 1000 for x in v]
            elif kind == "noise":
                v = [x * rnd.uniform(0.99, 1.01) for x in v]
            elif kind == "null":
                name = None
            elif kind == "decoy":
                v = [x * rnd.uniform(1.5, 3) for x in v]
            b = t * 10 + copy
            if kind != "decoy":
                true[b] = t
            for m, x in zip(months, v):
                row += 1
                raw.append((row, b, name, "total", rnd.choice([m, m + "-01", m[5:] + "." + m[:4]]) if x != v[0] else m, x, "x", "x"))
    return raw, ref, off, true


def test_matches_names_and_values(spark):
    raw, ref, off, true = world()
    raw += raw[:30] + [(10**6, None, "Заречный", "total", "2023-01", 1.0, "", ""), (10**6 + 1, 77777, None, "total", "2023-01", None, "", ""), (10**6 + 2, 88888, "", None, "x", float("nan"), "", "")]
    r, f, o = spark.createDataFrame(raw, RAW), spark.createDataFrame(ref, REF), spark.createDataFrame(off, OFF)
    for bucket in (64, 3):  # the small one drives common names through the composite keys
        got = {x.block_id: x.territory_id for x in match_blocks(r, f, o, max_bucket=bucket).collect()}
        right = sum(got.get(b) == t for b, t in true.items())
        wrong = [b for b, t in got.items() if true.get(b) != t]
        assert right >= 0.97 * len(true), bucket
        assert len(wrong) <= 0.03 * len(true), wrong
    assert match_blocks(r.limit(0), f, o).count() == 0
    assert match_blocks(r, f.limit(0), o).count() == 0


def test_names():
    assert parse_name("МО Осмултрепольский муниципальный округ")[:2] == parse_name("ОСМУЛТРЕПОЛЬСКИЙ  муниципальный округ")[:2]
    assert parse_name("гopoдcкoй oкpуг Пoлoттугopcк")[:2] == ("полоттугорск", "г")
    assert parse_name("Биснулраск (городской округ)")[:2] == ("биснулраск", "г")
    assert parse_name("г.о.Деймулчибор")[0] == "деймулчибор"
    assert parse_name("Заречный район (рег. 09)")[:3] == ("заречный", "р", "09")
    assert parse_name("Пехач. м.р-н") == ("пехач", "р", "", True)
    assert parse_name(None) == ("", "", "", False)
    assert stem("заречный") == "заречн"


def test_likeness_and_distance():
    assert edit_distance("заерчн", "заречн", 2) == 1
    assert edit_distance("кот", "собака", 2) == 3
    assert likeness("рыадзсугорский", "рыдазсугорский") > 0.65 > likeness("луговой", "речной")
    assert likeness("наглажлуборсикй", "наглажлуборский") > 0.65 and likeness("лугоой", "луговой") > 0.65


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    a, b = base[:200], base[100:300]  # Jaccard 1/3
    same = (minhash_keys(a, 240, 1, 1) == minhash_keys(b, 240, 1, 1)).mean()
    assert abs(same - 1 / 3) < 0.1


def test_stem_joins_a_place_with_its_adjective():
    for place, adjective in (("разопраово", "разопраовский"), ("яручниица", "яручниицкий"), ("эльозлувка", "эльозлувский"), ("глинибхледол", "глинибхледольский"), ("яраллуск", "яраллуский"), ("ургерсуино", "ургерсуинский"), ("нырабривец", "нырабривецкий")):
        assert stem(place) == stem(adjective)
    assert stem("заречный") != stem("заречинский")


def test_refits_on_other_draws_agree():
    rng = np.random.default_rng(2)
    n = 6000
    name, value = rng.choice(4, n, p=[0.5, 0.1, 0.1, 0.3]), rng.choice(3, n)  # same, close, none, other; agrees, differs, no figures
    short = rng.random(n) < 0.2
    x = np.zeros((n, len(FEATURES)))
    x[np.arange(n), name] = np.where(name == 1, rng.uniform(0.1, 0.9, n), 1.0)
    agree = np.where(value == 0, rng.uniform(0.8, 1, n), rng.uniform(0, 0.3, n)) * (value != 2)
    for column, part in (("agree_full", agree * ~short), ("agree_short", agree * short), ("differ", (1 - agree) * (value != 2)), ("no_figures", value == 2)):
        x[:, FEATURES.index(column)] = part
    sim = np.select([name == 0, name == 1], [1.0, 0.65 + 0.35 * x[:, 1]], 0.1)
    answers = []
    for seed in range(8):
        k = np.random.default_rng(seed).permutation(n)[:1500]
        model = fit_matcher(x[k], np.ones(len(k), np.int64), sim[k], np.ones(len(k), bool), k % 5)
        answers.append(model.probability(x) >= 0.5)
    clear = (value != 2) & (name != 2)  # half the chance agreements here are another name's: without a name they decide nothing
    assert (np.stack(answers) == answers[0]).all(axis=0)[clear].mean() > 0.995
    assert answers[0][(name == 1) & (value == 0)].all() and not answers[0][name == 3].any() and not answers[0][value == 1].any()


def test_nulls_empty_tables_and_repeated_rows(spark):
    raw, ref, off, true = world(40)
    r, f, o = spark.createDataFrame(raw, RAW), spark.createDataFrame(ref, REF), spark.createDataFrame(off, OFF)
    once = {(x.block_id, x.territory_id) for x in match_blocks(r, f, o).collect()}
    twice = match_blocks(r.unionByName(r), f.unionByName(f), o.unionByName(o)).collect()
    assert {(x.block_id, x.territory_id) for x in twice} == once and len(twice) == len(once)
    # without any official figures names alone decide, and never for a shared one
    named = {x.block_id: x.territory_id for x in match_blocks(r, f, o.limit(0)).collect()}
    assert named and all(t % 8 for t in named.values())
    empty = [(k, None, None, None, None, None, None, None) for k in range(3)] + [(9, 5, None, None, None, float("nan"), None, None), (10, 6, "", "", "", -1.0, "", "")]
    assert match_blocks(spark.createDataFrame(empty, RAW), f, o).count() == 0
    blank = spark.createDataFrame([(None,) * 9, (1, *(None,) * 8)], REF)
    assert match_blocks(r, blank, o).count() >= 0 and match_blocks(r, blank, o.limit(0)).count() == 0
    long = spark.createDataFrame([(10**6 + k, 10**6, "Барветгорский муниципальный округ " * 2000, "total", f"2023-{k + 1:02d}", 5.0, None, None) for k in range(12)], RAW)
    assert match_blocks(long, f, o).count() <= 1
