"""Evaluation texts leaking into training text, by latent semantic retrieval.

1. Items of equal passage and answer form one class; what is found for a class holds for all its members.
   A sentence that ``stock_from`` different passages share is an instruction and no part of a passage,
   counted over the whole evaluation set.
2. Words are counted over all documents (document frequencies): those of the passages one by one,
   all others by hash.
3. A distributed randomised SVD factorises the TF-IDF matrix of text windows of ``WINDOW`` words (a bounded
   sample, ``max_fit`` documents) and of the passages, which together carry ``PASSAGE_SHARE`` of its energy.
   Its rank lies well below the number of passages (or, of a few passages, at two for each), so that words that
   occur in the same windows fall together.
4. Every window of every document is projected into the latent space; its cosine there with a passage
   makes (document, class) a candidate.
5. A candidate is checked exactly on the whole text: each sentence of the passage must recur in one
   place of the text, by longest common subsequence and by weight of shared words.  An item is held
   if the recurring sentences make up half of the passage; just below it, its answer must occur too.

The evaluation set is a stated query set, taken in blocks of about ``block_items`` classes, one of which is on the
driver at a time; documents are mapped where they lie, without a shuffle, and nothing about a document leaves
its task but its findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronopanel.llm.codepoints import Words, slices
from kronopanel.llm.latent import randomized_svd
from kronopanel.session import materialize

WINDOW = 24
PASSAGE_SHARE = 0.25
OTHER_WORDS = 1 << 14  # hashed terms of words that no passage holds
FRAGMENT = 8  # fewest words of a sentence that count as its beginning or end
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_SLICE = 300_000


def _sentences(passages: list[str | None]) -> list[list[np.ndarray]]:
    """Word codes of each sentence of each passage."""
    texts, of = [], []
    for k, p in enumerate(passages):
        for s in _SENTENCE.split(p or ""):
            texts.append(s)
            of.append(k)
    w = Words(texts)
    b = w.bounds()
    out: list[list[np.ndarray]] = [[] for _ in passages]
    for s, k in enumerate(of):
        if b[s + 1] > b[s]:
            out[k].append(w.code[b[s] : b[s + 1]])
    return out


def _digest(codes: np.ndarray) -> int:
    """One signed 64-bit number of a sequence of word codes."""
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(items: DataFrame) -> DataFrame:
    """``i, class, passage, p, a, stock``: items with their class, and the digests of their sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sentences = _sentences(pdf["p"].tolist())
            answers = _sentences([x if isinstance(x, str) else None for x in pdf["a"]])
            whole = [np.concatenate([np.zeros(0, np.uint64), *s]) for s in sentences]
            mark = np.zeros(1, np.uint64)
            yield pd.DataFrame({
                "i": pdf["i"], "p": pdf["p"], "a": pdf["a"], "passage": [_digest(w) for w in whole], "size": [len(w) for w in whole],
                "class": [_digest(np.concatenate([w, mark, *a])) for w, a in zip(whole, answers)], "sentences": [[_digest(c) for c in s] for s in sentences],
            })

    return items.mapInPandas(run, "i long, p string, a string, passage long, size long, class long, sentences array<long>").where("size > 0")


class Passages:
    """A block of the evaluation set: its vocabulary, its sentences and their weights."""

    def __init__(self, items: pd.DataFrame):
        """``items(i, p, a, stock)``: class number, passage, answer, digests of sentences many passages share."""
        self.ids = items["i"].to_numpy(np.int64)
        kept = []
        for own, stock in zip(_sentences(items["p"].tolist()), items["stock"]):
            stock = set(stock if stock is not None else ())
            rest = [c for c in own if _digest(c) not in stock]
            # most of several sentences shared: a family of much the same passages, not an instruction
            family = len(own) - len(rest) > 1 and sum(map(len, rest)) < sum(map(len, own)) / 2
            kept.append(own if family else rest)
        sentences = [c for own in kept for c in own]
        self.terms = np.unique(np.concatenate(sentences)) if sentences else np.zeros(0, np.uint64)
        self.n_terms = len(self.terms) + OTHER_WORDS
        self.sentences = [[np.searchsorted(self.terms, c) for c in own] for own in kept]
        a = Words([x if isinstance(x, str) else None for x in items["a"]])
        ab = a.bounds()
        self.answers = [a.code[ab[k] : ab[k + 1]] for k in range(len(self.ids))]

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 outside it."""
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[at] == codes, at, -1)

    def term_of(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Term of each word: its place in the vocabulary, or behind it one of the hashed terms."""
        return np.where(at >= 0, at, len(self.terms) + (codes >> np.uint64(40)).astype(np.int64) % OTHER_WORDS)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.maximum(np.log((n_docs + 1.0) / (df + 1.0)), 0.05)
        self.checks, self.bounds = [], []
        for own in self.sentences:
            terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            weight = np.zeros((len(terms) + 1, len(own)))  # the last row: not a word of the item
            local = []
            for j, s in enumerate(own):
                loc = np.searchsorted(terms, s)
                weight[loc, j] = self.idf[s]
                local.append(loc)
            self.checks.append((terms, weight, local, weight.sum(0), [fragments(s) for s in own], np.concatenate([np.zeros(0, np.uint64), *[fragments(s) for s in own]])))
            count = np.stack([np.bincount(loc, minlength=len(terms)) for loc in local], axis=1) if local else np.zeros((0, 0))
            self.bounds.append((np.concatenate([weight[:-1], count], axis=1).astype(np.float32), np.array([len(x) for x in local])))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = at.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _possible(passages: Passages, k: int, there: np.ndarray, min_weight: float) -> float:
    """The most of passage ``k`` that the checks of ``_held`` can accept in a text with the words marked in ``there``.

    No pair of neighbours need survive: words may be put between any two.
    """
    both, sizes = passages.bounds[k]
    if not len(sizes):
        return 0.0
    got = there[passages.checks[k][0]].astype(np.float32) @ both
    total, n = passages.checks[k][3], len(sizes)
    most = np.where(got[:n] >= min_weight * total - 1e-3, sizes, np.where(got[:n] >= total / 4 - 1e-3, got[n:], 0))
    return float(most.sum() / sizes.sum())


def _held(passages: Passages, k: int, words: np.ndarray, there: np.ndarray, min_order: float, min_weight: float, least: float) -> float:
    """Share of passage ``k`` that recurs in ``words`` (vocabulary indices): sentences, and cut ones beside them.

    ``there`` are the sorted fragments of the text.  0 if the share cannot reach ``least``.
    """
    terms, weight, local, total, runs, all_runs = passages.checks[k]
    sizes = passages.bounds[k][1]
    all_words = int(sizes.sum())
    if not all_words:
        return 0.0
    loc = np.searchsorted(terms, words)
    loc = np.where(terms[np.minimum(loc, len(terms) - 1)] == words, loc, len(terms))
    run = np.zeros((len(loc) + 1, len(local)))
    np.cumsum(weight[loc], axis=0, out=run[1:])
    spans = np.minimum(len(loc), sizes + sizes // 2 + 4)
    # within the longest span no sentence gathers less than within its own
    likely = (run[spans.max() :] - run[: len(run) - spans.max()]).max(axis=0) >= min_weight * total - 1e-9
    missing = least * all_words - sizes[likely].sum()
    if missing > 0:  # only parts of sentences can make up for it: hits next to each other share all but one of their words
        hits = np.count_nonzero(there[np.minimum(np.searchsorted(there, all_runs), len(there) - 1)] == all_runs) if len(there) else 0
        if hits + (FRAGMENT - 1) * min(hits, len(local)) < missing:
            return 0.0
    held, cut = 0, []
    for j, s in enumerate(local):
        if likely[j]:
            sums = run[spans[j] :, j] - run[: len(run) - spans[j], j]
            best = int(np.argmax(sums))
            part = loc[max(0, best - spans[j] // 3) : best + spans[j] + spans[j] // 3]
            if sums[best] >= min_weight * total[j] and weight[np.unique(part), j].sum() >= min_weight * total[j] and common_subsequence(s, part) >= min_order * len(s):
                held += len(s)
                continue
        cut.append(j)
    if held < 0.5 * all_words:  # the passage may begin or end within a sentence
        for j in cut:
            size, end = longest_run(runs[j], there)
            if size and weight[np.unique(local[j][end - size : end]), j].sum() >= total[j] / 4:
                held += size
    return held / all_words


def fragments(words: np.ndarray) -> np.ndarray:
    """Codes of all runs of FRAGMENT words."""
    n = len(words) - FRAGMENT + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    code, w = np.zeros(n, np.uint64), words.astype(np.uint64)
    for i in range(FRAGMENT):
        code = code * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return code


def longest_run(own: np.ndarray, there: np.ndarray) -> tuple[int, int]:
    """Of a sentence's fragments, the longest series that a text holds (sorted): its words, and where it ends."""
    if not len(own) or not len(there):
        return 0, 0
    held = there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own
    edge = np.diff(np.concatenate(([0], held.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return 0, 0
    k = int(np.argmax(last - first))
    return int(last[k] - first[k]) + FRAGMENT - 1, int(last[k]) + FRAGMENT - 1


def _has_answer(answer: np.ndarray, codes: np.ndarray) -> bool:
    if not len(answer):
        return False
    starts = np.flatnonzero(codes == answer[0])
    return any(np.array_equal(codes[i : i + len(answer)], answer) for i in starts)


def _frequencies(documents: DataFrame, passages: Passages) -> tuple[np.ndarray, int]:
    """Document frequency of every term, and the number of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        total = np.zeros(p.n_terms + 1, np.int64)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["t"]]
            total[-1] += len(texts)
            for a, b in slices(texts):
                w = Words(texts[a:b])
                pairs = np.unique(w.doc * p.n_terms + p.term_of(w.code, p.lookup(w.code)))
                total[:-1] += np.bincount(pairs % p.n_terms, minlength=p.n_terms)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some.astype(np.int32), "n": total[some]})

    got = documents.select("t").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(passages.n_terms + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    shared.unpersist()
    return df[:-1], int(df[-1])


def _windows(w: Words) -> np.ndarray:
    """First word of every window."""
    first = w.bounds()
    place = np.arange(len(w.doc)) - first[w.doc]
    return np.flatnonzero(place % WINDOW == 0)


def _fit_rows(documents: DataFrame, passages: Passages, max_fit: int) -> DataFrame:
    """TF-IDF rows (``terms, weights``) of unit length: windows of at most ``max_fit`` documents, and the passages."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(passages)
    chosen = documents.select("d").distinct().orderBy(F.xxhash64("d"), "d").limit(max_fit)  # its bound is the parameter

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["t"]]
            for a, b in slices(texts):
                w = Words(texts[a:b])
                term = p.term_of(w.code, p.lookup(w.code))
                rows = np.split(term, _windows(w)[1:]) if len(term) else []
                yield pd.DataFrame({"terms": rows, "weights": [p.idf[r] / np.sqrt((p.idf[r] ** 2).sum()) for r in rows]})

    sample = documents.join(F.broadcast(chosen), "d", "left_semi").select("t").mapInPandas(windows, "terms array<int>, weights array<double>")
    sample = materialize(sample.limit(32 * max_fit), "windows")
    own = [np.unique(np.concatenate(o)) for o in passages.sentences if o]
    energy = sample.count() * PASSAGE_SHARE / (1 - PASSAGE_SHARE) or 1.0
    scale = [math.sqrt(energy / len(own) / (passages.idf[t] ** 2).sum()) for t in own]
    return sample.unionByName(spark.createDataFrame([(t.tolist(), (passages.idf[t] * c).tolist()) for t, c in zip(own, scale)], "terms array<int>, weights array<double>"))


class LatentIndex:
    """Word factors (weighted) and unit passage vectors in the latent space."""

    def __init__(self, passages: Passages, v: np.ndarray):
        self.words = np.concatenate([passages.idf[:, None] * v, np.zeros((1, v.shape[1]))]).astype(np.float32)  # the last: no word
        rows = [self.words[np.unique(np.concatenate(own))].sum(0) if own else np.zeros(v.shape[1], np.float32) for own in passages.sentences]
        items = np.stack(rows)
        self.items = (items / np.maximum(np.linalg.norm(items, axis=1), 1e-9)[:, None]).astype(np.float32)

    def candidates(self, w: Words, term: np.ndarray, cosine: float) -> np.ndarray:
        """Pairs (text number, item number) of which some window is close enough."""
        heads = _windows(w)
        # every window padded to WINDOW words: a sum over one axis is much faster than over ragged parts
        size = np.diff(np.append(heads, len(term)))
        full = np.full((len(heads), WINDOW), len(self.words) - 1)
        full[np.arange(WINDOW) < size[:, None]] = term
        latent = np.concatenate([self.words[full[a : a + 4096]].sum(axis=1) for a in range(0, len(full), 4096)])
        close = (latent @ self.items.T) >= (cosine * np.maximum(np.linalg.norm(latent, axis=1), 1e-9))[:, None]
        win, item = np.nonzero(close)
        return np.unique(np.stack([w.doc[heads[win]], item], axis=1), axis=0)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    answer: str = "answer",
    rank: int = 96,
    cosine: float = 0.6,
    min_order: float = 0.65,
    min_weight: float = 0.75,
    half: float = 0.5,
    near_half: float = 0.45,
    stock_from: int = 3,
    block_items: int = 4000,
    max_fit: int = 2000,
) -> DataFrame:
    """``doc_id, item_id, held, has_answer``: documents that hold at least half of an item's passage.

    Defined edge cases: a NULL or empty text or passage holds and is nothing; a document or item without
    id is left out; a repeated item counts once, items of equal passage and answer are each reported;
    repeated documents are each reported; a passage of one sentence that ``stock_from`` different passages
    share is never reported; empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null")
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p"), F.col(answer).alias("a")).where("i is not null and p is not null")
    known = materialize(_classes(known.groupBy("i").agg(F.min(F.struct("p", "a")).alias("r")).select("i", "r.*")), "items")
    shared_by = known.select("passage", F.explode(F.array_distinct("sentences")).alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n"))
    stock = known.select("class", F.explode("sentences").alias("s")).join(shared_by.where(F.col("n") >= stock_from), "s").groupBy("class").agg(F.collect_set("s").alias("stock"))
    classes = known.groupBy("class").agg(F.min(F.struct("p", "a")).alias("r")).select(F.col("class").alias("i"), "r.*").join(stock.withColumnRenamed("class", "i"), "i", "left")
    classes = materialize(classes, "classes")
    blocks = max(1, math.ceil(classes.count() / block_items))
    out = None
    for number in range(blocks):
        passages = Passages(classes.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == number).orderBy("i").toPandas())
        if not len(passages.terms):
            continue
        passages.weigh(*_frequencies(docs, passages))
        v, _ = randomized_svd(_fit_rows(docs, passages, max_fit), passages.n_terms, min(rank, 2 * len(passages.ids)))
        shared = spark.sparkContext.broadcast((passages, LatentIndex(passages, v)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            p, index = shared.value
            for pdf in batches:
                ids, texts = pdf["d"].to_numpy(), [t if isinstance(t, str) else None for t in pdf["t"]]
                for a, b in slices(texts, _SLICE):
                    w = Words(texts[a:b])
                    at = p.lookup(w.code)
                    if not (at >= 0).any():
                        continue
                    first = w.bounds()
                    found, there, last = [], np.zeros(len(p.terms) + 1, bool), -1
                    for d, k in index.candidates(w, p.term_of(w.code, at), cosine):
                        span = slice(first[d], first[d + 1])
                        if d != last:
                            there[:] = False
                            there[at[span]] = True  # -1, no word of the vocabulary, marks the place behind it
                            last, runs = d, None
                        if _possible(p, k, there, min_weight) < near_half:
                            continue
                        runs = np.sort(fragments(at[span])) if runs is None else runs
                        held = _held(p, k, at[span], runs, min_order, min_weight, near_half)
                        if held >= near_half:
                            has = _has_answer(p.answers[k], w.code[span])
                            if held >= half or has:
                                found.append((ids[a + d], p.ids[k], held, has))
                    if found:
                        yield pd.DataFrame(found, columns=["doc_id", "class", "held", "has_answer"])

        part = docs.mapInPandas(scan, "doc_id long, class long, held double, has_answer boolean")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, held double, has_answer boolean")
    return out.join(known.select("class", F.col("i").alias("item_id")), "class").select("doc_id", "item_id", "held", "has_answer")
