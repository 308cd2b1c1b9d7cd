"""A passage is judged sentence by sentence, however few of its neighbouring words stay neighbours."""

import random

from kronopanel.llm.leakage import leaked_items


def test_finds_half_a_passage_with_every_fifth_word_changed(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("бвгдклмнпрст") + rnd.choice("аеиоу") for _ in range(rnd.randrange(3, 6))) for _ in range(900)]
    items = [[[rnd.choice(words) for _ in range(15)] for _ in range(6)] for _ in range(12)]
    text = lambda sentences: " ".join((" ".join(s) + ".").capitalize() for s in sentences)
    changed = lambda s: [rnd.choice(words) if i % 5 == 2 else w for i, w in enumerate(s)]
    docs = [(k, text([changed(s) for s in x[:3]])) for k, x in enumerate(items)]
    docs += [(100 + k, text([[rnd.choice(words) for _ in range(15)] for _ in range(6)])) for k in range(40)]
    out = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, text(x), x[0][-1]) for k, x in enumerate(items)], "item_id long, passage string, answer string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert len(got) >= 9 and all(d == i for d, i in got)
