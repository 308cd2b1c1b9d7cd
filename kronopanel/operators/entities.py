"""Territory versions, names, blocks of an export, signatures and assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import squash_name


def digits_only(code: Column) -> Column:
    """A classifier code without blanks, dashes or a decimal tail; empty means NULL."""
    d = F.regexp_replace(F.regexp_replace(code, r"\.0+$", ""), "[^0-9]", "")
    return F.when(d != "", d)


def canonical_versions(reference: DataFrame, year: int) -> DataFrame:
    """One version per territory: one valid in ``year`` if there is any, else the newest earlier one."""
    valid = (F.col("year_from") <= year) & (F.col("year_to") >= year)
    order = Window.partitionBy("territory_id").orderBy(valid.desc(), F.col("year_from").desc(), "oktmo", "municipal_district_name", "municipal_district_type", "region_code", "municipal_district_center_lat")
    r = reference.where(F.col("year_from") <= year).dropDuplicates()
    return r.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def kind_changes(reference: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """Territories whose type differs between two years."""
    a, b = (canonical_versions(reference, y).select("territory_id", squash_name(F.col("municipal_district_type")).alias(f"kind_{n}")) for n, y in (("a", year_a), ("b", year_b)))
    return a.join(b, "territory_id").where("kind_a <> kind_b")


def region_of_code(codes: DataFrame, code: str, regions: DataFrame) -> DataFrame:
    """Region by the longest known prefix of a code: three characters, then two."""
    r3 = regions.where(F.length("region_code") == 3).select(F.col("region_code").alias("r3"))
    r2 = regions.where(F.length("region_code") == 2).select(F.col("region_code").alias("r2"))
    out = codes.join(F.broadcast(r3), F.substring(code, 1, 3) == F.col("r3"), "left").join(F.broadcast(r2), F.substring(code, 1, 2) == F.col("r2"), "left")
    return out.withColumn("region", F.coalesce("r3", "r2")).drop("r3", "r2")


#: The letters of the transliteration, and what each becomes.
_LETTERS = ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "abvgdeejzijklmnoprstufhccss_y_eua")


def slugify(text: Column) -> Column:
    """Cyrillic transliterated letter by letter, everything else but letters and digits to single dashes."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), *_LETTERS), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def column_key(text: Column) -> Column:
    """A name as part of a column's name: transliterated, every other sign an underscore, none at its ends, 40 characters at most."""
    plain = F.regexp_replace(F.translate(F.lower(text), *_LETTERS), "[^0-9a-z]", "_")
    return F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, 40)


def series_blocks(raw: DataFrame, order: str, keys: list[str], period: str, shard: Column | None = None) -> DataFrame:
    """Number the runs of an ordered export: a new block where a key changes or the period stops rising.

    The change flag needs just the previous row.  A global running sum would put all rows in one task,
    so rows are cut into shards by order, block starts are counted per shard, and each shard adds the
    number of starts before it.
    """
    shard = shard if shard is not None else F.floor(F.col(order) / (1 << 18))
    r = raw.withColumn("shard", shard)
    tails = r.groupBy("shard").agg(F.max_by(F.struct(*keys, period), order).alias("prev"), F.max(order).alias("last"))
    link = tails.select((F.lead("shard").over(Window.orderBy("shard"))).alias("shard"), "prev")
    by = Window.partitionBy("shard").orderBy(order)
    r = r.join(link.where("shard is not null"), "shard", "left")
    before = lambda c: F.when(F.row_number().over(by) == 1, F.col(f"prev.`{c}`")).otherwise(F.lag(c).over(by))
    first = (F.row_number().over(by) == 1) & F.col("prev").isNull()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(before(k))
    starts = (first | ~same | ~F.coalesce(F.col(period) > before(period), F.lit(False))).cast("int")
    r = r.withColumn("start", starts)
    counts = r.groupBy("shard").agg(F.sum("start").alias("n"))
    offset = counts.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return r.join(offset, "shard").withColumn("block", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")).drop("shard", "prev", "start", "offset")


def summarize_blocks(rows: DataFrame, block: str, period: str, value: str) -> DataFrame:
    return rows.groupBy(block).agg(F.countDistinct(period).alias("periods"), F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count(value).alias("n_values"), F.round(F.sum(value), 2).alias("total"))


def signatures(series: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """A digest of each series' whole content, independent of row order."""
    cell = F.concat_ws("=", F.col(position).cast("string"), F.bround(F.col(value), 0).cast("long").cast("string"))
    return series.groupBy(key).agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(cell))), 256).alias("signature"), F.count("*").alias("n"))


def signature_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose signature occurs exactly once on both sides."""
    one = lambda df, c: df.groupBy("signature").agg(F.count("*").alias("n"), F.min("key").alias(c)).where("n = 1").drop("n")
    return one(left, "left_key").join(one(right, "right_key"), "signature")


def unique_name_bridge(left: DataFrame, right: DataFrame, region: str, name: str) -> DataFrame:
    """Join by name within region, only where the name is unique on both sides."""
    keep = lambda df, c: df.groupBy(region, name).agg(F.countDistinct("key").alias("n"), F.min("key").alias(c)).where("n = 1").drop("n")
    return keep(left, "left_key").join(keep(right, "right_key"), [region, name])


def match_unique_code(names: DataFrame, reference: DataFrame) -> DataFrame:
    """``name, region`` -> the code, if the reference gives that name a single one in the region."""
    one = reference.groupBy("name", "region").agg(F.countDistinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").drop("n")
    return names.join(one, ["name", "region"], "left")


#: Words and abbreviations of territory kinds, which are no part of a name.
_KIND_WORDS = (
    r"(?U)\b(?:муниципальн(?:ый|ого|ое|ая)|внутригородск(?:ой|ого|ое|ая)|городск(?:ой|ого|ое|ая)|района?|округа?|город-курорт|города?|территори[яи]|федерального|значения|образование|"
    r"национальный|улус|кожуун|аймак|поселок городского типа|рабочий поселок|поселок|поселение|сельское|зато|м\W{0,2}р-н|р-н|м\W{0,2}о|г\W{0,2}о|вн|тер|г)\b\.?"
)


def name_root(name: Column) -> Column:
    """A territory's name without kind words, brackets and marks; Latin letters drawn like Cyrillic ones become those."""
    low = F.translate(F.replace(F.lower(name), F.lit("ё"), F.lit("е")), "abcehkmoptxy", "авсенкмортху")
    bare = F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), r"\([^)]*\)", " ")
    words = F.regexp_replace(F.regexp_replace(bare, _KIND_WORDS, " "), "[^0-9a-zа-я-]+", " ")
    return F.regexp_replace(words, "^[ -]+|[ -]+$", "")


def candidate_regions(names: DataFrame, reference: DataFrame) -> DataFrame:
    """Regions that know a name, by exact root, else by its stem."""
    stem = lambda c: F.regexp_replace(c, "(ский|цкий|ской|цкой|ый|ой|ий)$", "")
    exact = reference.groupBy("root").agg(F.sort_array(F.collect_set("region")).alias("exact"))
    loose = reference.withColumn("stem", stem(F.col("root"))).groupBy("stem").agg(F.sort_array(F.collect_set("region")).alias("loose"))
    out = names.join(exact, "root", "left").withColumn("stem", stem(F.col("root"))).join(loose, "stem", "left")
    return out.select("root", F.coalesce("exact", "loose", F.array().cast("array<string>")).alias("regions"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "stem").otherwise("none").alias("source"))


def crosswalk_agreement(pairs: DataFrame) -> DataFrame:
    """``left_key, right_key, territory``: how many left keys map one-to-one, are split or glued."""
    per_left = pairs.groupBy("left_key").agg(F.countDistinct("right_key").alias("rights"), F.countDistinct("territory").alias("territories"))
    per_right = pairs.groupBy("right_key").agg(F.countDistinct("left_key").alias("lefts"))
    j = pairs.join(per_left, "left_key").join(per_right, "right_key")
    return j.agg(F.countDistinct(F.when((F.col("rights") == 1) & (F.col("lefts") == 1), F.col("left_key"))).alias("one_to_one"), F.countDistinct(F.when(F.col("rights") > 1, F.col("left_key"))).alias("split"), F.countDistinct(F.when(F.col("lefts") > 1, F.col("right_key"))).alias("glued"), F.bool_and(F.col("territories") == 1).alias("same_territory"))


def forward_fill(rows: DataFrame, order: str, value: str, partition: str) -> DataFrame:
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order)))


def typical_share(panel: DataFrame, category: str, total: str) -> DataFrame:
    """Median log share of a category in its territory's total."""
    a = panel.where(F.col("category") == category).select("territory_id", "ds", F.col("y").alias("part"))
    b = panel.where(F.col("category") == total).select("territory_id", "ds", F.col("y").alias("whole"))
    return a.join(b, ["territory_id", "ds"]).where("part > 0 and whole > 0").agg(F.median(F.ln(F.col("part") / F.col("whole"))).alias("log_share"))


def assign(cost: np.ndarray) -> np.ndarray:
    """Least-cost assignment (rows <= columns): the column of each row, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, back = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = back[j0]
            owner[j0] = owner[j1]
            j0 = j1
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assign_within_groups(pairs: DataFrame, group: str, left: str, right: str, cost: str, max_side: int = 400) -> DataFrame:
    """One-to-one assignment of least total cost inside each group of ambiguous keys.

    The solve is cubic, so a group with more than ``max_side`` keys on a side is left without assignment.
    """
    sides = pairs.groupBy(group).agg(F.greatest(F.count_distinct(left), F.count_distinct(right)).alias("side")).where(F.col("side") <= max_side)
    pairs = pairs.join(sides.select(group), group, "left_semi")
    kinds = dict(pairs.dtypes)
    schema = f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, {cost} double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=left, columns=right, values=cost, aggfunc="min")
        c = wide.to_numpy(float)
        big = (np.nanmax(c) if np.isfinite(c).any() else 1.0) * 1000 + 1
        c = np.where(np.isnan(c), big, c)
        flip = c.shape[0] > c.shape[1]
        to = assign(c.T if flip else c)
        pick = [(t, i) if flip else (i, t) for i, t in enumerate(to)]
        rows = [(pdf[group].iloc[0], wide.index[i], wide.columns[j], c[i, j]) for i, j in pick if c[i, j] < big]
        return pd.DataFrame(rows, columns=[group, left, right, cost])

    return pairs.groupBy(group).applyInPandas(solve, schema)


def smooth_path(candidates: list[set[str]], states: list[str], switch: float = 0.45, miss: float = 1.0, unknown: float = 0.2) -> list[str]:
    """Viterbi over one ordered list: the region path that agrees with most candidates at least switches."""
    pay = np.array([[unknown if not c else (0.0 if s in c else miss) for s in states] for c in candidates])
    total, back = pay[0].copy(), []
    for row in pay[1:]:
        jump = int(np.argmin(total))
        stay = total <= total[jump] + switch
        back.append(np.where(stay, np.arange(len(states)), jump))
        total = np.where(stay, total, total[jump] + switch) + row
    k = int(np.argmin(total))
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return [states[k] for k in reversed(path)]
