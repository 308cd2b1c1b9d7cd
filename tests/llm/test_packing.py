import random

from kronopanel.llm.packing import TOKENIZER, _encoder, pack_documents, plan_sequences, token_lengths

S = "doc_id long, text string, n_tokens string, length string, bucket string"


def unfold(counts, capacity):
    """Every item's place, and the checks that hold for any packing."""
    plan = plan_sequences(counts, capacity)
    places, got = {}, {}
    for r in plan.itertuples(index=False):
        for rank in range(r.rank_from, r.rank_to):
            k = rank - r.rank_from
            places.setdefault(r.sequence_from + k // r.per_sequence, []).append((r.base + k % r.per_sequence * r.length, r.length))
            got.setdefault(r.length, []).append(rank)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for items in places.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:]))
        assert items[-1][0] + items[-1][1] <= capacity
    return places


def best_fit(counts, capacity):
    """Item-by-item best fit decreasing."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, x in enumerate(room) if x >= length]
            if fit:
                i = min(fit, key=lambda i: room[i])
                room[i] -= length
            else:
                room.append(capacity - length)
    return len(room)


def test_plan_equals_item_by_item_best_fit():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.choice([10, 37, 128])
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 25))}
        assert len(unfold(counts, capacity)) == best_fit(counts, capacity)
    assert unfold({}, 10) == {}


def test_plan_size_does_not_follow_the_number_of_documents():
    counts = {n: 1 + n % 7 for n in range(1, 129)}
    large = {n: c * 1_000_000 for n, c in counts.items()}
    assert len(plan_sequences(large, 128)) <= 3 * 128 * 7 + 3


def test_every_token_is_placed_once(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["расход", "price", "и", "1,5", "городской"]) for _ in range(rnd.choice([0, 1, 3, 9, 30, 200]))) for _ in range(150)]
    rows = [(i % 140, t, "x", "x", "x") for i, t in enumerate(texts)] + [(1000, None, "x", "x", "x"), (None, "a b c", "x", "x", "x"), (1001, "", "x", "x", "x")]
    df = spark.createDataFrame(rows, S)
    capacity = 64
    out = pack_documents(df, capacity=capacity, buckets=3).collect()
    with open(TOKENIZER, "rb") as f:
        encode = _encoder(f.read()).encode_ordinary
    want = sum(len(encode(r[1])) for r in rows if r[1])
    assert sum(r.n_tokens for r in out) == want
    used = {}
    for r in out:
        if r.sequence_id is None:
            assert r.n_tokens == 0 and r.position is None
        else:
            used.setdefault(r.sequence_id, []).append((r.position, r.n_tokens))
    for items in used.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
    for doc in {r.doc_id for r in out}:
        parts = [r for r in out if r.doc_id == doc]
        if len({r.token_from for r in parts}) > 1 and doc is not None and doc >= 10:  # only a text longer than the capacity is cut
            assert sum(r.n_tokens for r in parts) > capacity
    fill = want / (len(used) * capacity)
    assert fill > 0.9
    assert pack_documents(df.limit(0), capacity=capacity).count() == 0


def test_one_length_shared_by_all(spark):
    df = spark.createDataFrame([(i, "городской округ", "", "", "") for i in range(500)], S)
    n = token_lengths(df).first().n_tokens
    out = pack_documents(df, capacity=3 * n, buckets=7)
    assert out.count() == 500
    assert out.select("sequence_id").distinct().count() == 167
    assert out.groupBy("sequence_id", "position").count().where("count > 1").count() == 0
