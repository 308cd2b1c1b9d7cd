import random
import tracemalloc

import numpy as np

from kronopanel.llm.codepoints import Words
from kronopanel.llm.reading_level import Vocabulary, draw_pairs, fit_levels, isotonic, reading_levels, weighted_median

S = "sample_id long, lang string, level int, text string"
D = "doc_id long, text string, level string, score string, n_words string"


def words(rnd, level, n):
    """Words grow and sentences lengthen with the level."""
    out = []
    for i in range(n):
        out.append("".join(rnd.choice("бвгдклмнпрст") + rnd.choice("аеиоу") for _ in range(max(1, round(rnd.gauss(0.6 + level * 0.75, 0.5))))))
        if i % (3 + 3 * level) == 2 + 3 * level:
            out[-1] += "."
    return " ".join(out)


def samples(seed, n=20):
    rnd = random.Random(seed)
    return [(i, "ru", 1 + i % 5, words(rnd, 1 + i % 5, 60 + 40 * (i % 5))) for i in range(5 * n)]


def test_held_out_accuracy_and_mixtures(spark):
    model = fit_levels(spark.createDataFrame(samples(1), S))
    held = [(i, t, "x", "x", "x") for i, _, _, t in samples(2)]
    got = {r.doc_id: r for r in reading_levels(spark.createDataFrame(held, D), model).collect()}
    truth = {i: lv for i, _, lv, _ in samples(2)}
    assert np.mean([abs(got[i].level - truth[i]) <= 1 for i in truth]) > 0.97
    assert np.mean([(got[i].level == 5) == (truth[i] == 5) for i in truth]) > 0.97
    rnd = random.Random(3)
    mixed = [(1, words(rnd, 5, 400) + " " + words(rnd, 1, 150), "", "", ""), (2, words(rnd, 1, 400) + "\n" + words(rnd, 5, 150), "", "", ""), (3, words(rnd, 5, 300).replace(" ", "\n"), "", "", ""), (4, words(rnd, 5, 300).replace(".", ",").upper(), "", "", "")]
    got = {r.doc_id: r.level for r in reading_levels(spark.createDataFrame(mixed, D), model).collect()}
    assert got[1] == 5 and got[2] <= 2 and got[3] == 5 and got[4] == 5


def test_empty_and_odd_texts(spark):
    model = fit_levels(spark.createDataFrame(samples(1, 6), S))
    rows = [(1, None), (2, ""), (3, " \n.,!"), (4, "word"), (5, "слово " * 100_000), (5, "слово " * 100_000), (None, "a b")]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], D)
    out = reading_levels(df, model).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (1, 2, 3):
            assert r.n_words == 0 and r.level is None and r.score is None and r.top_share is None
        else:
            assert r.n_words > 0 and r.level is not None
    assert reading_levels(df.limit(0), model).count() == 0


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(1)
    s, y = rng.random(200), rng.integers(1, 6, 200)
    knots, values = isotonic(s, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()
    assert values.min() >= 1 and values.max() <= 5


def test_weighted_median():
    out = weighted_median(np.array([3.0, 1.0, 2.0, 9.0]), np.array([1, 1, 5, 2]), np.array([0, 0, 0, 2]), 3)
    assert out[0] == 2.0 and np.isnan(out[1]) and out[2] == 9.0


def test_pairs_are_drawn_without_a_matrix_of_all():
    level = np.repeat(np.arange(1, 6), 4000)  # 20,000 graded texts: 1.6e8 pairs
    tracemalloc.start()
    hi, lo = draw_pairs(level, 200_000)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert 199_000 < len(hi) <= 200_010 and (level[hi] > level[lo]).all()
    assert len(np.unique(np.stack([level[hi], level[lo]]), axis=1).T) == 10
    few = np.array([1, 1, 2, 3])
    assert {(a, b) for a, b in zip(*map(list, draw_pairs(few, 100)))} == {(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}


def test_layout_tables_and_split_sentences_do_not_move_a_level(spark):
    model = fit_levels(spark.createDataFrame(samples(1), S))
    rnd = random.Random(9)
    hard, easy = words(rnd, 5, 300), words(rnd, 1, 300)
    table = "\n".join(f"Город {k}; {k * 17}; {k * 3},5; {k}" for k in range(200))
    wrap = lambda t: "".join(c if c != " " or k % 7 else "\r\n" for k, c in enumerate(t))
    rows = [(1, hard + "\n\n" + table), (2, easy + "\n\n" + table), (3, wrap(hard)), (4, wrap(easy)), (5, hard.replace(". ", ".\n- ")), (6, table)]
    got = {r.doc_id: r.level for r in reading_levels(spark.createDataFrame([(*r, "", "", "") for r in rows], D), model).collect()}
    assert got[1] == got[3] == got[5] == 5
    assert got[2] == got[4] == 1 and got[6] is not None


def test_vocabulary_is_not_rated_by_the_text_itself():
    w = Words(["алый дом", "алый лес", "серый дом"])
    v = Vocabulary.learn(w, np.array([1.0, 5.0, 3.0]), np.array([0, 1, 2]))
    hardness, known = v.of(w.code)
    assert known.tolist() == [True, True, True, False, False, True]  # a word of one text is unknown
    assert hardness[0] == 0.0 and hardness[1] < 0
