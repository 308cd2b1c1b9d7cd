import random

import numpy as np
import pandas as pd

from kronopanel.llm.codepoints import Words
from kronopanel.llm.latent import randomized_svd
from kronopanel.llm.leakage import LatentIndex, Passages, _fit_rows, _frequencies, common_subsequence, leaked_items

D = "doc_id long, text string, item_id string, held string, lang string"
I = "item_id long, passage string, answer string, doc_id string"  # noqa: E741


def vocabulary(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("бвгдклмнпрст") + rnd.choice("аеиоу") for _ in range(rnd.randrange(2, 5))) for _ in range(n)]


def corpus():
    rnd = random.Random(5)
    words = vocabulary(900, 1)
    sentence = lambda n: (" ".join(rnd.choice(words) for _ in range(n)) + ".").capitalize()
    items = [[sentence(14) for _ in range(6)] for _ in range(12)]
    docs, true = [], set()

    def doc(text, item=None):
        docs.append((len(docs), text, "x", "x", "ru"))
        if item is not None:
            true.add((len(docs) - 1, item))

    for k, s in enumerate(items):
        doc(" ".join([sentence(12), *s, sentence(9)]), k)  # whole
        doc(" ".join(s[:4]), k)  # more than half
        doc(" ".join(s[:2] + [sentence(12) for _ in range(6)]))  # a third: no case
        doc("<p>" + "</p>\n<p>".join(x.upper() for x in rnd.sample(s, 5)) + "</p>", k)  # order, case, markup
        doc(" ".join(w for x in s for w in (x, sentence(10))), k)  # other sentences between
        doc(" ".join(" ".join(rnd.choice(words) if rnd.random() < 0.07 else w for w in x.split()) for x in s), k)  # a few words changed
        doc(" ".join(x.replace("о", "o").replace("е", "ё") for x in s), k)  # spelling
    for _ in range(60):
        doc(" ".join(sentence(14) for _ in range(rnd.randrange(1, 12))))
    return [(k, "Ответьте на вопрос. " + " ".join(s), s[0].split()[-1].strip("."), "x") for k, s in enumerate(items)], docs, true


def test_finds_every_leak_and_nothing_else(spark):
    items, docs, true = corpus()
    docs += [(900, None, "", "", ""), (901, "", "", "", ""), (None, items[0][1], "", "", ""), (902, "Ответьте на вопрос. " * 50, "", "", "")]
    items += [(50, None, None, ""), (51, "", None, ""), (None, "x y z", None, "")]
    out = leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()
    assert {(r.doc_id, r.item_id) for r in out} == true
    assert len(out) == len(true)


def test_blocks_of_items_give_the_same_result(spark):
    items, docs, true = corpus()
    out = leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), block_items=5).collect()
    assert {(r.doc_id, r.item_id) for r in out} == true


def test_empty_tables(spark):
    items, docs, _ = corpus()
    d, i = spark.createDataFrame(docs, D), spark.createDataFrame(items, I)
    assert leaked_items(d.limit(0), i).count() == 0
    assert leaked_items(d, i.limit(0)).count() == 0


def test_subsequence_by_brute_force():
    rnd = random.Random(3)
    for _ in range(50):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert common_subsequence(np.array(a), np.array(b)) == table[-1, -1]


def test_randomised_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 8)) @ rng.standard_normal((8, 30)) * (rng.random((40, 30)) < 0.9)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in a]
    v, s = randomized_svd(spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(3), 30, 30)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[: len(s)], rtol=1e-5, atol=1e-5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-5)


def test_words_fold_case_lookalikes_and_number_marks():
    same = lambda a, b: np.array_equal(Words([a]).code, Words([b]).code)
    assert same("Город Ёлка 39,7 из-за", "гopoд елка 397 изза")
    assert not same("город", "городу")
    long = Words(["слово " * 50000 + "конец", None, "", "конец"])
    assert long.code[50000] == long.code[-1] and len(set(long.code[:50000].tolist())) == 1
    assert long.bounds().tolist() == [0, 50001, 50001, 50001, 50002]


def test_repeated_items_and_shared_sentences_across_blocks(spark):
    """Items of several suites are each reported; an instruction is found whatever block its items fall in."""
    items, docs, true = corpus()
    items += [(100 + k, p, a, d) for k, p, a, d in items[:2]] + [(200 + k, p, a, d) for k, p, a, d in items[:2]]
    true |= {(d, i + base) for d, i in true for base in (100, 200) if i < 2}
    docs += [(902, "Ответьте на вопрос. " * 50, "", "", "")]
    for block_items in (4000, 5, 1):
        out = leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), block_items=block_items).collect()
        assert {(r.doc_id, r.item_id) for r in out} == true, block_items
        assert len(out) == len(true)


def test_latent_space_reaches_a_paraphrase_that_shares_no_weight(spark):
    """Words used in the same windows fall together, so a window in other words is close to the passage."""
    rnd = random.Random(11)
    topics = [(vocabulary(12, 100 + k), vocabulary(12, 500 + k)) for k in range(30)]  # two wordings of each topic
    mixed = [" ".join(rnd.choice(rnd.choice(t)) for _ in range(24)) for t in topics for _ in range(40)]
    passages = Passages(pd.DataFrame({"i": range(30), "p": [" ".join(t[0]) + "." for t in topics], "a": None, "stock": None}))
    docs = spark.createDataFrame(list(enumerate(mixed)), "d long, t string")
    passages.weigh(*_frequencies(docs, passages))
    v, _ = randomized_svd(_fit_rows(docs, passages, 2000), passages.n_terms, 20)
    w = Words([" ".join(rnd.choice(t[1]) for _ in range(24)) for t in topics])
    at = passages.lookup(w.code)
    own = {(k, k) for k in range(30)}
    shared = sum((at[w.doc == k] >= 0).sum() for k in range(30))
    assert shared < 0.05 * len(at)  # the plain cosine is about nothing
    got = {tuple(x) for x in LatentIndex(passages, v).candidates(w, passages.term_of(w.code, at), 0.55).tolist()}
    assert len(own & got) >= 27
    assert len(got) < 200
