"""Filling fixed-capacity sequences with documents by length-histogram planning.

Best fit decreasing runs over *counts of lengths*, not over documents: its input is a histogram of
at most ``capacity`` numbers, and its output a plan of slots.  Every document then takes the slot
planned for its rank within its length.  Ranks come from per-bucket row numbers plus the bucket's
offset, so a length shared by a third of all documents is ranked by many tasks.

The plan's size has a proven bound.  A group of equal sequences that takes items of length L ends
with a remainder below L and below half of what it had, so it is served at most log2(capacity)
times; each length opens at most two groups and splits at most one.  The plan thus has at most
3 * capacity * log2(capacity) rows whatever the number of documents, and is broadcast.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronopanel.session import materialize, shuffle_width

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048

_encoders: dict[int, object] = {}


def _encoder(data: bytes):
    import tiktoken

    key = hash(data)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("planned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_lengths(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, h`` (hash of the text) of every row; a NULL text has none.

    ``tokenizer`` is a rank file of a public byte-level vocabulary, read on the driver and broadcast
    (its size is that of the vocabulary).
    """
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["d"], "h": pdf["h"], "n_tokens": [len(encode(t)) if isinstance(t, str) else 0 for t in pdf["t"]]})

    return documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInPandas(count, "doc_id long, n_tokens long, h long")


def plan_sequences(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Best fit decreasing over a length histogram.

    A row gives items of ``length`` with rank ``rank_from <= r < rank_to`` their places: sequence
    ``sequence_from + (r - rank_from) // per_sequence`` at ``base + (r - rank_from) % per_sequence * length``.
    """
    rows, room = [], {}  # room: space left -> groups [first sequence, number of sequences]
    spaces: list[int] = []
    next_sequence = 0

    def add(space: int, first: int, n: int) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(spaces, space)
        room[space].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = room[space][-1]
                per = space // length
                use, take = min(n, max(1, left // per)), per
                if left < per:
                    use, take = 1, left
                if use == n:
                    room[space].pop()
                    if not room[space]:
                        del room[space], spaces[i]
                else:
                    room[space][-1] = [first + use, n - use]
            else:
                space, per = capacity, capacity // length
                use, take = max(1, left // per), min(per, left)
                first, next_sequence = next_sequence, next_sequence + use
            rows.append((length, rank, rank + use * take, first, take, capacity - space))
            rank, left = rank + use * take, left - use * take
            if space > take * length:
                add(space - take * length, first, use)
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "sequence_from", "per_sequence", "base"]).astype("int64")


def pack_documents(documents: DataFrame, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, buckets: int | None = None) -> DataFrame:
    """``sequence_id, position, doc_id, token_from, n_tokens``: every token of every document, once.

    Only a document longer than ``capacity`` is cut, into full sequences and one remainder.
    ``position`` is where the piece begins in its sequence, ``token_from`` where it begins in the
    document.

    Defined edge cases: a text without tokens (NULL, empty) takes no room: one row with ``n_tokens``
    0 and NULL ``sequence_id`` and ``position``; repeated rows and NULL ids are each packed; an empty
    table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    n = buckets or max(16, 4 * shuffle_width(spark))
    sizes = token_lengths(documents, doc_id=doc_id, text=text, tokenizer=tokenizer)
    part = F.explode(F.when(F.col("n_tokens") <= capacity, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity))))
    pieces = sizes.withColumn("part", part).select(
        "doc_id", (F.col("part") * capacity).alias("token_from"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * capacity).alias("length"),
        F.pmod(F.xxhash64("doc_id", "part", "h"), F.lit(n)).cast("int").alias("bucket"),
    )
    pieces = materialize(pieces, "pieces")

    tally = materialize(pieces.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    if len(plan) > 3 * capacity * max(1, int(np.ceil(np.log2(capacity)))) + 3:  # proven above: broadcasting more would be an error of the plan
        raise RuntimeError("the plan outgrew its bound")
    slots = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, base long")

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "token_from")
    ranked = pieces.where("length > 0").withColumn("r", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("offset"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    k = F.col("rank") - F.col("rank_from")
    placed = placed.select(
        (F.col("sequence_from") + F.floor(k / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("base") + k % F.col("per_sequence") * ranked["length"]).cast("long").alias("position"),
        "doc_id", "token_from", ranked["length"].alias("n_tokens"),
    )
    nothing = F.lit(None).cast("long")
    return placed.unionByName(pieces.where("length = 0").select(nothing.alias("sequence_id"), nothing.alias("position"), "doc_id", "token_from", F.col("length").alias("n_tokens")))
