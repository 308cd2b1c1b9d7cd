"""Matching series blocks to territories that share no key with them.

Blocking.  A block whose stem is a stem of the reference meets the territories of that stem; a pair whose
names are plainly different is never a match, so other keys could add nothing to it.  All other blocks
(misspelt, abbreviated or missing names), and a bounded probe of the rest that shows the classifier
what chance agreement looks like, use keys of every attribute: MinHash keys of the 3-grams of the stem,
keys of an abbreviation's first letters, MinHash keys of the (month, level) cells of a series, where levels are
logarithms modulo a factor 1000, so that a change of unit keeps them, and keys of its monthly changes, which any factor keeps.  A series that is short or without
name also uses its runs of three months.

A name key that more than ``max_bucket`` territories share makes no pairs by itself: its blocks are reached
through each stem behind the key together with a run of values (a series of few runs: with single
cells of a grid wide enough for noise), with the kind, the region, or both.  A pair without common
figures that none of these reaches shares stem, kind and region with more than ``max_bucket`` territories,
and its confidence, divided among them, stays below ``least``.  Value keys always count in full.

Scoring.  Pairs get evidence of name, kind, region and values; a logistic classifier adds it up.  It is
trained on weak labels (unambiguous pairs that agree or disagree in both attributes, also shown with the
name hidden), in which every combination of evidence has the same weight, and calibrated by isotonic regression on margins
of models that did not see the label (five folds), for pairs with and without a name apart.  The labelled sample is bounded by ``max_labels`` and the
probe by ``max_probe``; everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date
from kronopanel.llm.reading_level import isotonic
from kronopanel.session import materialize

#: Latin letters drawn like Cyrillic ones.
_LATIN = str.maketrans("abcehkmoptxy", "авсенкмортху")
#: Words and abbreviations of territory kinds; the first letter group decides the kind.
_KIND_WORDS = re.compile(
    r"\b(?:муниципальн\w*|внутригородск\w*|городск\w*|район\w*|округ\w*|город\w*|территори\w*|федеральн\w*|значени\w*|образовани\w*|"
    r"м\W{0,2}р-н|р-н|м\W{0,2}о|г\W{0,2}о|мо|го|вн|тер|окр|г)\b\.?"
)
_REGION = re.compile(r"\(\s*рег\w*\.?\s*(\d{1,3})\s*\)")
#: Endings of the adjective made from a place name, then those of the place name itself.
_ADJECTIVE = re.compile(r"(?:(?<=ц)к(?:ий|ой|ая|ое)|ь?ск(?:ий|ой|ая|ое)?|[ыио]й|ая|ое)$")
_NOUN = re.compile(r"(?:ка|[аеиоыья])$")
NAME_BANDS, NAME_ROWS = 20, 4
VALUE_BANDS, VALUE_ROWS = 32, 4
_LOG_UNIT = float(np.log(1000.0))
LEVELS = 115  # levels per factor 1000: about 6 % each
CELLS = 57  # levels of single cells: two grids, half a level apart, keep values up to 6 % apart together
SHAPE_STEP = 0.01  # step of a monthly change in a key of shapes
SHORT = 10
PREFIX = (3, 4, 5)  # letters of an abbreviated name that make a key


def parse_name(name: str | None) -> tuple[str, str, str, bool]:
    """(root, kind, region, abbreviated) of a territory name as exported."""
    if not isinstance(name, str):
        return "", "", "", False
    s = " ".join(name.lower().replace("ё", "е").split()).translate(_LATIN)
    hint = _REGION.search(s)
    region = hint.group(1).zfill(2) if hint else ""
    s = _REGION.sub(" ", s)
    if re.search(r"внутригор|\bвн\b", s):
        kind = "в"
    elif re.search(r"\bгородск|\bг\W{0,2}о\b|\bгород\b|\bг\.", s):
        kind = "г"
    elif re.search(r"район|р-н", s):
        kind = "р"
    elif re.search(r"округ|м\W{0,2}о\b", s):
        kind = "о"
    else:
        kind = ""
    if re.search(r"\bмо\b", s) and not re.search(r"округ|район|городск", s):
        kind = ""  # 'municipal formation' may be of any kind
    rest = _KIND_WORDS.sub(" ", s)
    words = re.findall(r"[a-zа-я-]+\.?", rest)
    short = any(w.endswith(".") and len(w) > 3 for w in words)
    root = " ".join(w.strip(".-") for w in words if len(w.strip(".-")) > 1)
    return root, kind, region, short


@lru_cache(100_000)
def stem(root: str) -> str:
    """What a place name and the adjective made from it share, word by word."""
    out = []
    for word in root.split():
        short = _NOUN.sub("", _ADJECTIVE.sub("", word))
        out.append(short if len(short) > 2 else word)
    return " ".join(out)


def grams(root: str) -> frozenset[str]:
    s = f"^{stem(root)}$"
    return frozenset(s[i : i + 3] for i in range(max(1, len(s) - 2)))


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def likeness(a: str, b: str) -> float:
    """1 for equal stems, high for a slip or two of the pen, else the overlap of 3-grams."""
    if stem(a) == stem(b):
        return 1.0
    g, h = grams(a), grams(b)
    overlap = len(g & h) / len(g | h)
    most = 1 if min(len(a), len(b)) < 7 else 2
    # a slip within the ending leaves a stem that is no stem, so whole words count as well
    slips = min(edit_distance(a, b, most), edit_distance(stem(a), stem(b), most))
    return max(overlap, 0.94 - 0.12 * slips) if slips <= most else min(overlap, 0.6)


def _hash(text: str) -> int:
    h = 1469598103934665603
    for b in text.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 31, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhash_keys(tokens: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """One 64-bit key per band of a token set (uint64 hashes)."""
    n = bands * rows
    sign = _mix(tokens[:, None] * _A[None, :n] + _B[None, :n]).min(axis=0).reshape(bands, rows)
    key = np.full(bands, salt, np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(31) + sign[:, r] + np.arange(bands, dtype=np.uint64))
    return key


def _levels(values: np.ndarray, shift: float = 0.0, levels: int = LEVELS) -> np.ndarray:
    return np.floor(np.mod(np.log(values) / _LOG_UNIT, 1.0) * levels + shift).astype(np.int64) % levels


def _scatter(a: int) -> int:
    return a * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def value_keys(category: str, months: np.ndarray, values: np.ndarray) -> np.ndarray:
    c = np.uint64(_hash(category))
    token = _mix(c + (months * 1000 + _levels(values)).astype(np.uint64))
    return minhash_keys(token, VALUE_BANDS, VALUE_ROWS, 2)


def run_keys(category: str, months: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Keys of all runs of three consecutive months, on two shifted level grids."""
    out = []
    c = np.uint64(_hash(category))
    at = np.flatnonzero((months[2:] - months[:-2]) == 2) if len(months) > 2 else np.zeros(0, np.int64)
    for grid, shift in enumerate((0.0, 0.5)):
        lv = _levels(values, shift)
        code = ((months[at] * 1000 + lv[at]) * 1000 + lv[at + 1]) * 1000 + lv[at + 2]
        out.append(_mix(code.astype(np.uint64) + np.uint64(_scatter(int(c) + grid + 1))))
    return np.concatenate(out)


def shape_keys(category: str, months: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Keys of the changes within all runs of four months, whatever the level; a run without change has none."""
    at = np.flatnonzero((months[3:] - months[:-3]) == 3) if len(months) > 3 else np.zeros(0, np.int64)
    change = np.diff(np.log(values))
    out = []
    for grid, shift in enumerate((0.0, 0.5)):
        step = np.clip(np.floor(change / SHAPE_STEP + shift), -400, 400).astype(np.int64) + 500
        code = ((months[at] * 1000 + step[at]) * 1000 + step[at + 1]) * 1000 + step[at + 2]
        moved = (np.abs(change[at]) + np.abs(change[at + 1]) + np.abs(change[at + 2])) > SHAPE_STEP
        out.append(_mix(code[moved].astype(np.uint64) + np.uint64(_scatter(_hash(category) + grid + 21))))
    return np.concatenate(out)


def cell_keys(category: str, months: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Keys of all single months, on two grids of wide levels."""
    c = _hash(category)
    return np.concatenate([_mix((months * 1000 + _levels(values, shift, CELLS)).astype(np.uint64) + np.uint64(_scatter(c + grid + 11))) for grid, shift in enumerate((0.0, 0.5))])


def name_keys(root: str) -> np.ndarray:
    if not root:
        return np.zeros(0, np.uint64)
    token = np.array([_hash(g) for g in grams(root)], np.uint64)
    return minhash_keys(token, NAME_BANDS, NAME_ROWS, 1)


def _series(df: DataFrame, ids: list[str], category: str, month, value, order) -> DataFrame:  # noqa: ANN001
    """One row per id and category with arrays of months and positive values (one per month)."""
    good = F.when((value > 0) & (value < 1e300) & ~F.isnan(value), value)
    cells = df.select(*ids, F.col(category).alias("category"), month.alias("m"), good.alias("v"), order.alias("o"))
    cells = cells.groupBy(*ids, "category", "m").agg(F.min_by("v", F.when(F.col("v").isNotNull() & F.col("m").isNotNull(), F.struct("o", "v"))).alias("v"))
    kept = F.sort_array(F.collect_list(F.when(F.col("v").isNotNull() & F.col("m").isNotNull(), F.struct("m", "v"))))
    return cells.groupBy(*ids, "category").agg(kept.alias("c")).select(*ids, "category", F.col("c.m").alias("m"), F.col("c.v").alias("v"))


def _month_of(text: str):  # noqa: ANN202
    d = flexible_date(F.col(text).cast("string"))
    return F.year(d) * 12 + F.month(d)


def _block_rows(raw: DataFrame) -> DataFrame:
    named = raw.where("block_id is not null").select(F.col("block_id").cast("long").alias("b"), "category_15", "period", F.col("value").cast("double").alias("value"), F.col("row_no").cast("long").alias("row_no"), "mo")
    series = _series(named, ["b"], "category_15", _month_of("period"), F.col("value"), F.col("row_no"))
    # a block has one category; should rows disagree, the one with most months speaks for it
    main = series.groupBy("b").agg(F.max_by(F.struct("category", "m", "v"), F.struct(F.size("m"), "category")).alias("s")).select("b", "s.*")
    return main.join(named.groupBy("b").agg(F.min("mo").alias("mo")), "b")


def _territory_rows(reference: DataFrame) -> DataFrame:
    """One row per territory: its names, the regions its codes give."""
    code = F.regexp_replace(F.coalesce(F.col("oktmo"), F.lit("")), "[^0-9]", "")
    region = F.array_compact(F.array(F.trim("region_code"), F.when(F.length(code) >= 8, F.substring(code, 1, 2))))
    rows = reference.where("territory_id is not null").select(F.col("territory_id").cast("long").alias("t"), F.col("municipal_district_name").alias("n"), F.concat_ws(" ", "municipal_district_name_short", "municipal_district_type").alias("n2"), region.alias("r"), F.col("municipal_district_name_short").alias("sn"))
    name = F.coalesce("n", F.when(F.col("sn").isNotNull(), F.col("n2")))
    return rows.groupBy("t").agg(F.collect_set(name).alias("names"), F.array_distinct(F.flatten(F.collect_list("r"))).alias("regions"))


_KEYS = "id long, kind string, key long"
FRAME = 100_000  # keys after which a frame goes out, whatever the size of the batch read


def _emit(ids: list[int], kinds: list[str], keys: list[np.ndarray]) -> pd.DataFrame:
    n = [len(k) for k in keys]
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return pd.DataFrame({"id": np.repeat(np.array(ids, np.int64), n), "kind": np.repeat(np.array(kinds, object), n), "key": flat.view(np.int64)})


def _framed(rows: Callable[[pd.DataFrame], Iterator[tuple[int, str, np.ndarray]]]):  # noqa: ANN202
    """Frames of keys from ``(id, kind, keys)`` rows: a worker never holds more than FRAME keys and those of one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, n = [], 0
            for row in rows(pdf):
                held.append(row)
                n += len(row[2])
                if n >= FRAME:
                    yield _emit(*map(list, zip(*held)))
                    held, n = [], 0
            if held:
                yield _emit(*map(list, zip(*held)))

    return run


def _pair(a: int, b: np.ndarray | int) -> np.ndarray:
    return _mix(np.asarray(b, np.uint64).reshape(-1) + np.uint64(_scatter(a)))


@_framed
def _root_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    for b, mo in zip(pdf["b"], pdf["mo"]):
        root, _, _, short = parse_name(mo)
        if root and not short:
            yield b, "root", _pair(_hash(stem(root)), 7)


@_framed
def _wide_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    """Keys of every attribute but the stem itself."""
    for b, cat, m, v, mo in zip(pdf["b"], pdf["category"], pdf["m"], pdf["v"], pdf["mo"]):
        m, v = np.asarray(m, np.int64), np.asarray(v, float)
        root, _, _, short = parse_name(mo)
        if root:
            yield (b, "prefix", prefix_keys(root, False)) if short else (b, "name", name_keys(root))
        if cat is not None and len(m):
            if len(m) >= SHORT:
                yield b, "value", value_keys(cat, m, v)
                yield b, "shape", shape_keys(cat, m, v)
            if len(m) < SHORT or not root:  # nothing but values leads to a block without name
                yield b, "run", run_keys(cat, m, v)


def prefix_keys(root: str, full: bool) -> np.ndarray:
    """Of a full name the first letters at every length of PREFIX, of an abbreviation the longest that it has."""
    sizes = [n for n in PREFIX if n <= len(root)] or [len(root)]
    return np.concatenate([_pair(_hash(root[:n]), 50 + n) for n in (sizes if full else sizes[-1:])])


def _of_kind(h: int, kind: str, region: str) -> np.ndarray:
    return _pair(h, _hash(f"{kind}|{region}"))


@_framed
def _linked_values(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    """Keys of the values of a block whose crowded keys lead to stems: once, not once for each stem."""
    for b, cat, m, v in zip(pdf["b"], pdf["category"], pdf["m"], pdf["v"]):
        m, v = np.asarray(m, np.int64), np.asarray(v, float)
        if cat is not None and len(m):
            values = run_keys(cat, m, v)
            # too few runs (on two grids) to outlast noise
            yield b, "both", values if len(values) >= 2 * SHORT else cell_keys(cat, m, v)
            if len(m) >= SHORT:
                yield b, "shape", shape_keys(cat, m, v)


@_framed
def _linked_kinds(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    """Keys of a block's kind and region with a stem its crowded keys lead to."""
    for b, mo, h in zip(pdf["b"], pdf["mo"], pdf["stem"]):
        _, kind, region, _ = parse_name(mo)
        for k, r in {(kind, ""), ("", region), (kind, region)}:
            if k or r:
                yield b, "kind", _of_kind(int(h) & 0xFFFFFFFFFFFFFFFF, k, r)


def _keys_of_name(root: str) -> tuple[tuple[str, np.ndarray], ...]:
    return ("root", _pair(_hash(stem(root)), 7)), ("name", name_keys(root)), ("prefix", prefix_keys(root, True))


@_framed
def _territory_name_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    for t, names, regions in zip(pdf["t"], pdf["names"], pdf["regions"]):
        parsed = {parse_name(n)[:2] for n in names}
        for root in {r for r, _ in parsed} - {""}:
            for kind, k in _keys_of_name(root):
                yield t, kind, k
        for root, kind in parsed:
            h = _hash(stem(root))
            for k, r in {(kind, ""), *(("", r) for r in regions), *((kind, r) for r in regions)} if root else ():
                if k or r:
                    yield t, "kind", _of_kind(h, k, r)


@_framed
def _stem_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    """The name keys of each stem, under the stem's hash."""
    for root in {parse_name(n)[0] for names in pdf["names"] for n in names} - {""}:
        h = int(np.uint64(_hash(stem(root))).astype(np.int64))
        for kind, k in _keys_of_name(root):
            yield h, kind, k


def _stems_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, int(np.uint64(h).astype(np.int64))) for t, names in zip(pdf["t"], pdf["names"]) for h in map(_hash, {stem(parse_name(n)[0]) for n in names} - {""})]
        yield pd.DataFrame(rows, columns=["t", "stem"])


@_framed
def _territory_value_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    for t, cat, m, v in zip(pdf["t"], pdf["category"], pdf["m"], pdf["v"]):
        m, v = np.asarray(m, np.int64), np.asarray(v, float)
        if cat is not None and len(m):
            yield t, "value", value_keys(cat, m, v)
            yield t, "run", run_keys(cat, m, v)
            yield t, "shape", shape_keys(cat, m, v)


@_framed
def _crowded_value_keys(pdf: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray]]:
    """Runs and cells of the series of a territory with a crowded stem."""
    for t, cat, m, v in zip(pdf["t"], pdf["category"], pdf["m"], pdf["v"]):
        m, v = np.asarray(m, np.int64), np.asarray(v, float)
        if cat is not None and len(m):
            yield t, "both", run_keys(cat, m, v)
            yield t, "both", cell_keys(cat, m, v)


def candidate_pairs(blocks: DataFrame, territories: DataFrame, series: DataFrame, max_bucket: int, max_probe: int) -> DataFrame:
    """Distinct (b, t, wide); ``wide`` blocks were looked for by all their attributes."""
    roots = materialize(blocks.select("b", "mo").mapInPandas(_root_keys, _KEYS), "block-roots")
    # crowded keys are counted, and those are keys of names: only they must be distinct here
    right = territories.mapInPandas(_territory_name_keys, _KEYS).distinct().unionByName(series.mapInPandas(_territory_value_keys, _KEYS))
    right = materialize(right, "territory-keys").withColumnRenamed("id", "t")
    known = roots.join(right.where("kind = 'root'").select("kind", "key").distinct(), ["kind", "key"], "left_semi").select(F.col("id").alias("b"))
    probe = blocks.select("b").orderBy(F.xxhash64("b"), "b").limit(max_probe)
    wide = materialize(blocks.join(known.join(probe, "b", "left_anti"), "b", "left_anti"), "wide-blocks")
    left = materialize(wide.mapInPandas(_wide_keys, _KEYS).unionByName(roots), "block-keys")

    sizes = right.where("kind in ('root', 'name', 'prefix', 'kind')").groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("kind", "key")
    sizes = materialize(sizes, "crowded-keys")
    few = right.join(sizes, ["kind", "key"], "left_anti")
    crowded = left.join(sizes, ["kind", "key"], "left_semi")
    # every stem behind a crowded key counts, not only the block's own: names come misspelt and abbreviated
    behind = materialize(territories.mapInPandas(_stem_keys, _KEYS).distinct().join(sizes, ["kind", "key"], "left_semi").withColumnRenamed("id", "stem"), "crowded-stems")
    links = materialize(crowded.join(behind, ["kind", "key"]).select(F.col("id").alias("b"), "stem").distinct(), "links")
    # values meet as (stem, key of values): a block with many stems and many months is never multiplied out in memory
    linked = materialize(blocks.join(links.select("b").distinct(), "b", "left_semi").mapInPandas(_linked_values, _KEYS), "linked-keys").withColumnRenamed("id", "b")
    kinds = links.join(blocks.select("b", "mo"), "b").mapInPandas(_linked_kinds, _KEYS).withColumnRenamed("id", "b")
    owners = materialize(territories.mapInPandas(_stems_of, "t long, stem long").join(behind.select("stem").distinct(), "stem", "left_semi"), "crowded-owners")
    both = series.join(owners.select("t").distinct(), "t", "left_semi").mapInPandas(_crowded_value_keys, _KEYS).withColumnRenamed("id", "t").join(owners, "t").select("stem", "key", "t")
    parts = [
        left.join(few, ["kind", "key"]).withColumnRenamed("id", "b"),
        linked.where("kind = 'both'").join(links, "b").join(both, ["stem", "key"]),
        linked.where("kind = 'shape'").join(few.where("kind = 'shape'"), ["kind", "key"]),
        kinds.join(few.where("kind = 'kind'"), ["kind", "key"]),
    ]
    pairs = reduce(DataFrame.unionByName, [p.select("b", "t") for p in parts]).distinct()
    return pairs.join(wide.select("b", F.lit(True).alias("wide")), "b", "left").fillna(False, ["wide"])


#: Months count as agreeing within CLOSE; the level itself must agree within LEVEL (a short series) or FIRM (a full one):
#: wider than the noise of an export, narrower than a factor of five per cent.  Beyond that level a full series
#: still agrees in shape, if its months keep one factor to the figures within TIGHT.
CLOSE, LEVEL, FIRM, TIGHT = 0.06, 0.0475, 0.03, 0.005
FULL = 8  # months from which a series is judged as a full one
NOISE = 0.01  # usual distance of an export from the figures
ALIKE = 0.65  # likeness from which a name counts as misspelt rather than another
FEATURES = ("same_name", "close_name", "no_name", "other_name", "kind_same", "kind_other", "region_same", "region_other", "agree_full", "agree_short", "agree_shape", "differ", "no_figures")
SAME, CLOSE_NAME, UNNAMED, OTHER, KIND_OTHER, REGION_OTHER, AGREE_FULL, AGREE_SHORT, AGREE_SHAPE, DIFFER, NONE = 0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12
CELLS_HELD = 250_000  # months of pairs compared at a time: a stray year widens the time axis
_FEATURE_COLS = [f"f{i}" for i in range(len(FEATURES))]
_SCORED = "b long, t long, wide boolean, n_same long, months int, sim double, away double, " + ", ".join(f"{c} double" for c in _FEATURE_COLS)


def _features(first_month: int, n_months: int):  # noqa: ANN202
    def dense(ms: pd.Series, vs: pd.Series) -> np.ndarray:
        out = np.full((len(ms), n_months), np.nan)
        size = [0 if m is None else len(m) for m in ms]
        if sum(size):
            filled = np.flatnonzero(size)
            ms, vs = ms.to_numpy(), vs.to_numpy()
            out[np.repeat(np.arange(len(ms)), size), np.concatenate(ms[filled]).astype(np.int64) - first_month] = np.concatenate(vs[filled])
        return np.log(out)

    def middle(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Medians of rows with n numbers each, at least one; the rest is NaN, which sorts last."""
        x, at = np.sort(x, axis=1), np.arange(len(x))
        return (x[at, (n - 1) // 2] + x[at, n // 2]) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = lru_cache(20_000)(parse_name)
        alike = lru_cache(50_000)(likeness)
        rows = max(1, CELLS_HELD // n_months)
        for pdf in (batch.iloc[i : i + rows] for batch in batches for i in range(0, len(batch), rows)):
            d = dense(pdf["bm"], pdf["bv"]) - dense(pdf["tm"], pdf["tv"])
            common = np.sum(~np.isnan(d), axis=1)
            some = common > 0
            gap, close, away, shape = np.full(len(d), 1.0), np.zeros(len(d)), np.full(len(d), 1.0), np.zeros(len(d))
            if some.any():
                x, n = d[some], common[some]
                med = middle(x, n)[:, None]
                shape[some] = np.sum(np.abs(x - med) < TIGHT, axis=1) / n
                x = x - np.clip(np.round(med / _LOG_UNIT), -1, 1) * _LOG_UNIT
                gap[some] = np.abs(middle(x, n))
                close[some] = np.sum(np.abs(x) < CLOSE, axis=1) / n
                away[some] = middle(np.abs(x), n)
            full = common >= FULL
            agree = close * (gap < np.where(full, FIRM, LEVEL))
            shape = shape * full * (agree == 0)
            f = np.zeros((len(pdf), len(FEATURES)))
            same, sims = np.ones(len(pdf), np.int64), np.zeros(len(pdf))
            for i, (mo, names, regions, counts) in enumerate(zip(pdf["mo"], pdf["names"], pdf["regions"], pdf["kin"])):
                root, kind, region, short = parsed(mo)
                best = (-1.0, 0, 0, (1, 1, 1, 1))
                for n, c in zip(names, counts):
                    r2, k2 = parsed(n)[:2]
                    if root and r2:
                        sim = (1.0 if r2.startswith(root) else 0.0) if short else alike(root, r2)
                        best = max(best, (sim, int(bool(kind) and kind == k2), int(bool(kind) and kind != k2), (c["k"], c["rk"], c["s"], c["rs"])), key=lambda x: x[:3])
                known = [r for r in regions if r]
                here, elsewhere = bool(region) and region in known, bool(region) and bool(known) and region not in known
                sims[i] = sim = max(best[0], 0.0)
                f[i, :8] = (sim == 1, (sim - ALIKE) / (1 - ALIKE) if ALIKE < sim < 1 else 0, not root, bool(root) and sim <= ALIKE, best[1] * (sim > 0.3), best[2] * (sim > 0.3), here, elsewhere)
                k, rk, s, rs = best[3]
                same[i] = max(1, (rk if here else k) if kind else (rs if here else s))
            f[:, AGREE_FULL], f[:, AGREE_SHORT], f[:, AGREE_SHAPE], f[:, DIFFER], f[:, NONE] = agree * full, agree * (some & ~full), shape, (1 - agree - shape) * some, ~some
            yield pd.DataFrame({"b": pdf["b"].to_numpy(), "t": pdf["t"].to_numpy(), "wide": pdf["wide"].to_numpy(), "n_same": same, "months": common.astype(np.int32), "sim": sims, "away": away, **{c: f[:, j] for j, c in enumerate(_FEATURE_COLS)}})

    return run


class MatchModel:
    """Logistic regression and its isotonic calibrations: of pairs with a name, and of those without."""

    def __init__(self, weights: np.ndarray, named: tuple[np.ndarray, np.ndarray], unnamed: tuple[np.ndarray, np.ndarray]):
        self.weights, self.named, self.unnamed = weights, named, unnamed

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = _margin(x, self.weights)
        return np.where(x[:, UNNAMED] > 0, np.interp(m, *self.unnamed), np.interp(m, *self.named))


def _margin(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


def weak_labels(x: np.ndarray, n_same: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """1 match, 0 no match, -1 unclear."""
    same, unnamed, none = x[:, SAME] > 0, x[:, UNNAMED] > 0, x[:, NONE] > 0
    agree = x[:, AGREE_FULL : DIFFER].sum(1)
    agrees, differs = ~none & (agree >= 0.6), ~none & (agree < np.where(x[:, AGREE_FULL] > 0, 0.6, 0.4))
    here = x[:, REGION_OTHER] == 0
    other = ~unnamed & (sim < 0.3)
    y = np.full(len(x), -1)
    y[same & (n_same == 1) & here & agrees] = 1
    y[same & (n_same == 1) & here & none & (x[:, KIND_OTHER] == 0)] = 1  # a territory without official figures
    y[(sim > ALIKE) & here & agrees] = 1  # a misspelt name, the right figures
    y[differs] = 0
    y[other] = 0  # be it with the figures of a territory of another name
    y[same & none & ~here] = 0
    return y


def _hidden_names(x: np.ndarray, y: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of blocks looked for by all attributes, without their names: what values alone are worth."""
    keep = wide & (x[:, UNNAMED] == 0) & (x[:, NONE] == 0)
    h = x[keep].copy()
    h[:, :AGREE_FULL] = 0
    h[:, UNNAMED] = 1
    return h, y[keep]


def _cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by which every combination of name, values and label counts alike within its label."""
    name = np.argmax(np.stack([x[:, SAME], (x[:, CLOSE_NAME] > 0) + 0.0, x[:, UNNAMED], x[:, OTHER]], axis=1), axis=1)
    value = np.argmax(x[:, AGREE_FULL:], axis=1)
    _, cell, n = np.unique((name * 5 + value) * 2 + y.astype(int), return_inverse=True, return_counts=True)
    w = 1.0 / n[cell]
    for label in (0, 1):
        w[y == label] *= 0.5 / max(w[y == label].sum(), 1e-12)
    return w * len(x)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    out = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ out, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(out)), z.T @ (w * (y - p)) - ridge * out)
        out += step
        if np.abs(step).max() < 1e-8:
            break
    return out


def fit_matcher(x: np.ndarray, n_same: np.ndarray, sim: np.ndarray, wide: np.ndarray, fold: np.ndarray, ridge: float = 1e-3) -> MatchModel:
    """``fold`` (0 to 4) of a pair is that of its block.  The ridge is relative to the number of rows."""
    y = weak_labels(x, n_same, sim)
    x, wide, fold, y = x[y >= 0], wide[y >= 0], fold[y >= 0], y[y >= 0]
    h, hy = _hidden_names(x, y, wide)
    fold = np.concatenate([fold, fold[wide & (x[:, UNNAMED] == 0) & (x[:, NONE] == 0)]])
    x, y = np.concatenate([x, h]), np.concatenate([y, hy]).astype(float)
    if len(set(y.tolist())) < 2:  # nothing to learn from: an agreeing name and agreeing figures decide
        plain = np.zeros(len(FEATURES) + 1)
        plain[[SAME, CLOSE_NAME, OTHER, AGREE_FULL, AGREE_SHORT, AGREE_SHAPE, DIFFER, -1]] = 2, 2, -8, 4, 2, 2, -4, -1
        return MatchModel(plain, *[(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))] * 2)
    w = _cells(x, y)
    margin = np.zeros(len(x))
    for k in range(5):
        out = fold == k
        if out.any():
            inside = ~out if len(set(y[~out].tolist())) == 2 else np.ones(len(x), bool)
            margin[out] = _margin(x[out], _logistic(x[inside], y[inside], w[inside], ridge * inside.sum()))
    named = x[:, UNNAMED] == 0
    both = [isotonic(margin[k], y[k], edges=True) if len(set(y[k].tolist())) == 2 else isotonic(margin, y, edges=True) for k in (named, ~named)]
    return MatchModel(_logistic(x, y, w, ridge * len(x)), *both)


def match_blocks(
    raw_blocks: DataFrame,
    reference: DataFrame,
    official: DataFrame,
    *,
    max_bucket: int = 64,
    max_labels: int = 40_000,
    max_probe: int = 2_000,
    least: float = 0.5,
) -> DataFrame:
    """``block_id, territory_id, confidence``: the best territory of each block that has one.

    ``raw_blocks(row_no, block_id, mo, category_15, period, value)``, ``reference`` (territory versions)
    and ``official(date, territory_id, category, value)``.  Where figures cannot decide between the
    territories that share a block's name, or names between territories with the same figures, the
    confidence is divided among them (by ``NOISE`` where one fits better).

    Defined edge cases: rows without block or territory id are left out; a block without name is matched
    by values, one without positive values by name; a repeated row counts once (of two values for one
    month the first by ``row_no`` holds); equal confidence goes to the closer figures, then the smaller
    id; empty tables give an empty result; other columns are ignored.
    """
    spark = raw_blocks.sparkSession
    blocks = materialize(_block_rows(raw_blocks), "blocks")
    figures = official.select(F.col("territory_id").cast("long").alias("t"), "category", "date", F.col("value").cast("double").alias("value")).where("t is not null")
    series = materialize(_series(figures, ["t"], "category", _month_of("date"), F.col("value"), F.col("value")).where(F.size("m") > 0), "figures")
    territories = _with_kin(_territory_rows(reference))
    territories = materialize(territories, "territories")
    max_bucket = max(max_bucket, int(np.ceil(1 / least)))  # else a pair beyond it might still be confident
    pairs = candidate_pairs(blocks, territories, series.join(territories.select("t"), "t", "left_semi"), max_bucket, max_probe)

    span = blocks.select(F.explode("m").alias("m")).unionByName(series.select(F.explode("m").alias("m"))).agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    first, n = (span.a, span.b - span.a + 1) if span.a is not None else (0, 1)
    # all figures of a territory come with its names: pairs carry the values of their block only, through one exchange
    kept = series.where("category is not null").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("m", "v")))).alias("figures"))
    joined = pairs.join(blocks.select("b", "mo", "category", F.col("m").alias("bm"), F.col("v").alias("bv")), "b").join(territories.join(kept, "t", "left"), "t")
    own = F.try_element_at("figures", "category")
    joined = joined.select("b", "t", "wide", "mo", "bm", "bv", own["m"].alias("tm"), own["v"].alias("tv"), "names", "regions", "kin")
    scored = materialize(joined.mapInPandas(_features(first, n), _SCORED), "scored")
    # pairs that agree in something are a small part of all candidates: they get three quarters of the sample
    alike = (F.col("sim") > ALIKE) | (F.col(f"f{AGREE_FULL}") + F.col(f"f{AGREE_SHORT}") + F.col(f"f{AGREE_SHAPE}") >= 0.6)
    draw = lambda rows, n: rows.orderBy(F.xxhash64("b", "t"), "b", "t").limit(n)
    sample = draw(scored.where(alike), max_labels * 3 // 4).unionByName(draw(scored.where(~alike), max_labels // 4)).withColumn("fold", F.pmod(F.xxhash64("b"), F.lit(5))).toPandas()
    model = spark.sparkContext.broadcast(fit_matcher(sample[_FEATURE_COLS].to_numpy(), *(sample[c].to_numpy() for c in ("n_same", "sim", "wide", "fold"))))

    def confidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[_FEATURE_COLS].to_numpy()
            p = model.value.probability(x) if len(x) else np.zeros(0)
            none = x[:, NONE] > 0
            p = np.where(none, p / np.maximum(pdf["n_same"].to_numpy(), 1), p)
            fit = np.where(none, 0.0, np.exp(-pdf["away"].to_numpy() / NOISE))
            yield pd.DataFrame({"b": pdf["b"], "t": pdf["t"], "p": p, "fit": fit, "name": (2 * (x[:, SAME] > 0) + (x[:, CLOSE_NAME] > 0)).astype(np.int32)})

    rated = scored.mapInPandas(confidence, "b long, t long, p double, fit double, name int").where(F.col("p") >= least)
    best = rated.groupBy("b").agg(
        F.max_by(F.struct("t", "p", "fit", "name"), F.struct("name", "p", "fit", (-F.col("t")).alias("nt"))).alias("m"),
        *[F.sum(F.when(F.col("name") == k, F.col("fit"))).alias(f"all{k}") for k in range(3)],
    )
    # several territories of one name, or of none, with much the same figures
    share = F.when(F.col("m.fit") > 0, F.col("m.fit") / F.element_at(F.array("all0", "all1", "all2"), F.col("m.name") + 1)).otherwise(1.0)
    return best.select(F.col("b").alias("block_id"), F.col("m.t").alias("territory_id"), (F.col("m.p") * share).alias("confidence")).where(F.col("confidence") >= least)


def _with_kin(territories: DataFrame) -> DataFrame:
    """Per name: how many territories share its stem and kind, or its stem, in all and in the same region."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, n, stem(parse_name(n)[0]), parse_name(n)[1], next((r for r in regions if r), "")) for t, names, regions in zip(pdf["t"], pdf["names"], pdf["regions"]) for n in names]
            yield pd.DataFrame(rows, columns=["t", "n", "root", "kind", "region"])

    names = materialize(territories.mapInPandas(roots, "t long, n string, root string, kind string, region string"), "names")
    counts = [names.groupBy(*by).agg(F.count_distinct("t").alias(c)) for c, by in (("k", ["root", "kind"]), ("rk", ["root", "kind", "region"]), ("s", ["root"]), ("rs", ["root", "region"]))]
    kin = names
    for c, by in zip(counts, (["root", "kind"], ["root", "kind", "region"], ["root"], ["root", "region"])):
        kin = kin.join(c, by)
    back = kin.groupBy("t").agg(F.sort_array(F.collect_set(F.struct("n", "k", "rk", "s", "rs"))).alias("x"))
    empty = F.array().cast("array<struct<n:string,k:bigint,rk:bigint,s:bigint,rs:bigint>>")
    x = F.coalesce("x", empty)
    return territories.select("t", "regions").join(back, "t", "left").select("t", F.coalesce("regions", F.array().cast("array<string>")).alias("regions"), x["n"].alias("names"), x.alias("kin"))
