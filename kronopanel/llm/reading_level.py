"""Reading level of each document.

A linear ranker is learned from pairs of graded documents (the harder one should score higher) on
vocabulary and syntax features; isotonic regression then turns scores into levels.  Ranker and
calibration are fitted per script, because word lengths of two languages do not compare.

Vocabulary: how hard the words are that graded texts know (the shrunken mean level of the texts that use
a word), which share of the words none of them knows, and word lengths.  Syntax: words to a clause, subordinating
words, marks, numbers; stops and clause marks count alike, so that a text whose clauses were split into sentences keeps its features.  A word's hardness is always taken from other graded texts than the
one it helps to rate, and the calibration sees only scores of rankers that did not see the text (five folds).

A document is scored in passages of whole sentences, at least ``PASSAGE`` words apart and at most ``LONGEST`` words long, so that
a text without marks is cut as well.  Passages that are mostly numbers are tables and carry no weight
beside prose.  The document's score is the word-weighted median of its passages, so that quotations, leads or
lists of another level do not move it.  The graded documents are a bounded sample (``max_graded``, the ranker's
pairs ``max_pairs``); scoring is one map over the corpus without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronopanel.llm import codepoints
from kronopanel.llm.codepoints import Words, slices

PASSAGE, LONGEST = 16, 48
TABLE = 0.35  # share of numbers from which a passage is a table
FOLDS = 5
SHRINK = 2.0  # graded texts of mean level that every word's hardness starts from
FEATURES = ("hardness", "unknown", "mean_length", "share_7", "share_10", "share_13", "share_short", "clause", "subordination", "numbers", "marks")
_CYRILLIC, _OTHER_SCRIPT = 1, 0
#: Words that open subordinate clauses.
SUBORDINATORS = (
    "что чтобы который которая которое которые которых которого которой которым если когда хотя поскольку пока тогда как так причём вопреки несмотря невзирая "
    "that which who whom whose whereas although though because since while unless until albeit notwithstanding provided whether if when"
).split()


class Vocabulary:
    """Hardness of words, by their hash."""

    def __init__(self, code: np.ndarray, hardness: np.ndarray, mean: float):
        self.code, self.hardness, self.mean = code, hardness, mean

    @staticmethod
    def learn(w: Words, level: np.ndarray, texts: np.ndarray) -> Vocabulary:
        """From the texts marked in ``texts`` (their numbers), each counting once per word."""
        own = np.isin(w.doc, texts) & ~w.is_number
        pairs = np.unique(np.stack([w.code[own], w.doc[own].astype(np.uint64)], axis=1), axis=0)
        code, at, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
        mean = float(level[texts].mean()) if len(texts) else 0.0
        total = np.bincount(at, weights=level[pairs[:, 1].astype(np.int64)] - mean, minlength=len(code))
        shared = n > 1  # a word of one text says no more than that text
        return Vocabulary(code[shared], (total / (n + SHRINK))[shared], mean)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hardness of each word (0 if unknown), and whether it is known."""
        if not len(self.code):
            return np.zeros(len(code)), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        known = self.code[at] == code
        return np.where(known, self.hardness[at], 0.0), known


_OPENERS = np.sort(Words(SUBORDINATORS).code)


class Passages:
    """Features of every passage of a batch of texts."""

    def __init__(self, w: Words, vocabulary: Vocabulary):
        first = w.bounds()
        n = np.diff(first)
        self.n_words = n
        words = len(w.start)
        # marks: the word before each stop or clause mark; a blank line ends a sentence, a line break may be mere layout
        mark = np.flatnonzero((w.point_kind == codepoints.STOP) | (w.point_kind == codepoints.COMMA))
        ends = np.flatnonzero(w.point_kind == codepoints.STOP)
        lines = np.cumsum(w.points == 10)
        before = lambda at: np.unique((x := np.searchsorted(w.start, at, side="right") - 1)[x >= 0])
        clause_end, sentence_end = np.zeros(words, bool), np.zeros(words, bool)
        clause_end[before(mark)] = True  # a run of marks after a word counts once
        sentence_end[before(ends)] = True
        sentence_end[:-1] |= np.diff(lines[w.start]) > 1
        opens = np.ones(words, bool)
        opens[1:] = sentence_end[:-1] | (w.doc[1:] != w.doc[:-1])
        head = np.flatnonzero(opens)
        place = np.arange(words) - (head[np.cumsum(opens) - 1] if words else 0)
        opens |= place % LONGEST == 0  # a text without marks is cut by words
        # sentences that begin within the same PASSAGE words of a text belong together
        head = np.flatnonzero(opens)
        bucket = (head - first[w.doc[head]]) // PASSAGE if words else head
        new = np.ones(len(head), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (w.doc[head[1:]] != w.doc[head[:-1]])
        start = head[new]
        g = np.searchsorted(start, np.arange(words), side="right") - 1
        total = len(start)
        self.text = w.doc[start]
        word = (~w.is_number).astype(float)
        size = np.minimum(w.length, 30) * word
        tally = lambda x: np.bincount(g, weights=x, minlength=total)
        count = np.bincount(g, minlength=total)
        letters = np.maximum(tally(word), 1)
        hardness, known = vocabulary.of(w.code)
        known = known & ~w.is_number
        lead = w.points[w.start] if words else np.zeros(0, np.uint32)
        self.script = np.where(tally(((lead >= 0x400) & (lead < 0x530)) * word) * 2 > tally(word), _CYRILLIC, _OTHER_SCRIPT)
        numbers = 1 - tally(word) / np.maximum(count, 1)
        prose = numbers <= TABLE
        some = np.bincount(self.text[prose], minlength=w.n_texts) > 0
        self.weight = np.where(prose | ~some[self.text], count, 0) if total else count
        opener = _OPENERS[np.minimum(np.searchsorted(_OPENERS, w.code), len(_OPENERS) - 1)] == w.code
        self.x = np.stack(
            [
                tally(hardness * known) / np.maximum(tally(known.astype(float)), 1), 1 - tally(known.astype(float)) / letters,
                tally(size) / letters, tally((size >= 7) * word) / letters, tally((size >= 10) * word) / letters, tally((size >= 13) * word) / letters, tally((size <= 3) * word) / letters,
                count / np.maximum(tally(clause_end.astype(float)), 1),
                tally(opener.astype(float)) / letters, numbers, tally(clause_end.astype(float)) / np.maximum(count, 1),
            ], axis=1,
        )


class LevelModel:
    """The vocabulary; per script: standardisation, ranker weights, and the calibration's steps."""

    def __init__(self, vocabulary: Vocabulary, parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.vocabulary, self.parts = vocabulary, parts

    def levels(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """Score and calibrated level of each passage."""
        score, level = np.full(len(p.x), np.nan), np.full(len(p.x), np.nan)
        fallback = next(iter(self.parts.values()), None)
        for script in (_CYRILLIC, _OTHER_SCRIPT):
            part = self.parts.get(script, fallback)
            at = p.script == script
            if part is None or not at.any():
                continue
            mean_sd, weights, knots, values = part
            score[at] = ((p.x[at] - mean_sd[0]) / mean_sd[1]) @ weights
            level[at] = np.interp(score[at], knots, values)
        return score, level


def weighted_median(value: np.ndarray, weight: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Lower weighted median of each group; NaN for an empty one."""
    order = np.lexsort((value, group))
    v, w, g = value[order], weight[order].astype(float), group[order]
    total = np.bincount(g, weights=w, minlength=groups)
    before = np.concatenate(([0], np.cumsum(total)))[:-1]
    reached = np.cumsum(w) - before[g] >= total[g] / 2
    out = np.full(groups, np.nan)
    hit, first = np.unique(g[reached], return_index=True)
    out[hit] = v[reached][first]
    return out


def draw_pairs(level: np.ndarray, max_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """(harder, easier) pairs: all of them, or ``max_pairs`` drawn level against level, never a matrix of all."""
    groups = [np.flatnonzero(level == v) for v in np.unique(level)]
    sizes = [(i, j, len(groups[i]) * len(groups[j])) for i in range(len(groups)) for j in range(i)]
    total = sum(n for _, _, n in sizes)
    rng = np.random.default_rng(0)
    hi, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, n in sizes:
        if total <= max_pairs:
            pair = np.arange(n)
        else:
            pair = rng.integers(0, n, max(1, int(max_pairs * n / total)))
        hi.append(groups[i][pair // len(groups[j])])
        lo.append(groups[j][pair % len(groups[j])])
    return np.concatenate(hi), np.concatenate(lo)


def _fit_ranker(x: np.ndarray, level: np.ndarray, max_pairs: int, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression without intercept on feature differences of (harder, easier) pairs."""
    hi, lo = draw_pairs(level, max_pairs)
    d = x[hi] - x[lo]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, level: np.ndarray, *, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values.

    A pool has one knot, at its mean score, or with ``edges`` two, at its least and greatest score: for
    labels that separate, where the middle of the gap is meant to count as undecided.
    """
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # mean, weight, mean score, least, greatest
    for s, y in zip(score[order], level[order].astype(float)):
        pools.append([y, 1.0, s, s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            y2, w2, s2, _, most = pools.pop()
            y1, w1, s1, least, _ = pools[-1]
            pools[-1] = [(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, (s1 * w1 + s2 * w2) / (w1 + w2), least, most]
    b = np.array(pools)
    return (b[:, 3:].reshape(-1), np.repeat(b[:, 0], 2)) if edges else (b[:, 2], b[:, 0])


def fit_levels(graded: DataFrame, *, text: str = "text", level: str = "level", max_graded: int = 20_000, max_pairs: int = 200_000) -> LevelModel:
    """Fit on at most ``max_graded`` graded documents (the first by hash of the text) and ``max_pairs`` pairs of them."""
    sample = graded.select(F.col(text).alias("t"), F.col(level).cast("double").alias("y")).where("t is not null and y is not null").orderBy(F.xxhash64("t"), "t", "y").limit(max_graded).toPandas()
    return fit_model(sample["t"].tolist(), sample["y"].to_numpy(), max_pairs)


def fit_model(texts: list[str], y: np.ndarray, max_pairs: int = 200_000) -> LevelModel:
    w = Words(texts)
    everyone = np.arange(len(texts))
    same: dict[str, int] = {}
    fold = np.array([same.setdefault(t, len(same)) % FOLDS for t in texts], np.int64)  # a repeated text stays in one fold
    # every text's words are rated by the other folds' texts
    held = [Passages(w, Vocabulary.learn(w, y, everyone[fold != k] if (fold != k).any() else everyone)) for k in range(FOLDS)]
    plain = held[0]
    x = np.where((fold[plain.text] == 0)[:, None], held[0].x, 0.0) if len(plain.text) else plain.x
    for k in range(1, FOLDS):
        x = np.where((fold[plain.text] == k)[:, None], held[k].x, x)
    parts = {}
    for script in (_CYRILLIC, _OTHER_SCRIPT):
        own = (plain.script == script) & (plain.weight > 0)
        if not own.any():
            continue
        # a document of a pair is represented by one of its passages, since passages are what is scored
        of, own_y = plain.text[own], y[plain.text[own]]
        mean, sd = x[own].mean(0), np.maximum(x[own].std(0), 1e-9)
        z = (x[own] - mean) / sd
        score = np.zeros(len(z))
        for k in range(FOLDS):
            out = fold[of] == k
            rest = ~out if len(set(own_y[~out].tolist())) > 1 else np.ones(len(z), bool)
            score[out] = z[out] @ _fit_ranker(z[rest], own_y[rest], max_pairs)
        parts[script] = (np.stack([mean, sd]), _fit_ranker(z, own_y, max_pairs), *isotonic(score, own_y))
    return LevelModel(Vocabulary.learn(w, y, everyone), parts)


def reading_levels(documents: DataFrame, model: LevelModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, score, level_value, level, top_share`` for every document.

    ``level_value`` is the calibrated level of the document's median passage, ``level`` the nearest
    whole level, ``top_share`` the share of its words in passages of the top level.

    Defined edge cases: a NULL text or one without words has ``n_words`` 0 and NULL elsewhere; a text
    in a script without graded samples is scored by the other script's model; repeated rows are scored
    each; an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    top = max((float(part[3].max()) for part in model.parts.values()), default=np.inf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["t"]]
            for a, b in slices(texts):
                p = Passages(Words(texts[a:b]), shared.value.vocabulary)
                score, level = shared.value.levels(p)
                of = p.text
                known = ~np.isnan(score) & (p.weight > 0)
                med = weighted_median(score[known], p.weight[known], of[known], b - a)
                value = weighted_median(level[known], p.weight[known], of[known], b - a)
                words = np.bincount(of, weights=p.weight, minlength=b - a)
                high = np.bincount(of[known], weights=(p.weight * (level >= top - 0.5))[known], minlength=b - a)
                nearest = pd.Series(np.floor(value + 0.5)).astype("Int64")
                yield pd.DataFrame({"doc_id": pdf["d"].to_numpy()[a:b], "n_words": p.n_words, "score": med, "level_value": value, "level": nearest, "top_share": np.where(words > 0, high / np.maximum(words, 1), np.nan)})

    out = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, n_words long, score double, level_value double, level int, top_share double")
    none = F.lit(None).cast("double")
    return out.select("doc_id", "n_words", *[F.nanvl(c, none).alias(c) for c in ("score", "level_value")], "level", F.nanvl("top_share", none).alias("top_share"))
