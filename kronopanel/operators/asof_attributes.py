"""Attributes as known at event time (bitemporal as-of lookup).

Events and attribute changes are co-grouped by entity; inside a group one vectorised binary
search per attribute finds the version that was valid and already recorded at each event's
moment.  The versions of an attribute are sorted by the day they were recorded and turned into
a running best, so a single ``searchsorted`` answers all events of the group.

Scale.  An entity with more than ``rows_per_group`` rows is *hot*: it is cut into calendar
months.  A month's group holds the changes recorded in it plus one *carry* row per attribute
(the best of all earlier months, from a pre-aggregated prefix maximum), and its events are
salted so that no group outgrows one task; changes are first reduced to one version per
attribute and recording day, so that a copy for every salt stays small.  Nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.session import materialize

#: An entity absent from the feed of entities: attributes of this scope apply to every event.
SHARED = "all"
_NO_DAY = -(2**31)


def normalized_kind(kind: Column) -> Column:
    """``Known-Future`` / `` PAST only`` -> ``known_future`` / ``past_only``."""
    return F.regexp_replace(F.lower(F.trim(kind)), r"[\s\-_]+", "_")


def attributes_as_of(
    events: DataFrame,
    changes: DataFrame,
    *,
    event_id: str = "event_id",
    event_entity: str = "region_code",
    moment: Column | None = None,
    change_id: str = "value_id",
    change_entity: str = "region_code",
    attribute: str = "block",
    kind: str = "kind",
    valid: str = "ds",
    recorded: str = "published_at",
    value: str = "value",
    shared: str = SHARED,
    rows_per_group: int = 200_000,
) -> DataFrame:
    """One row per (event, attribute) that had a usable version at the event's moment.

    A version is usable if it has a value (NaN is none), a recording date not after the moment
    and, for kind ``known_future``, a validity month equal to the month of the moment.  Of the
    usable ones the latest ``valid`` wins (NULL is the earliest), then the latest ``recorded``,
    then the smallest id.  Versions of entity ``shared`` apply to every event.

    Defined edge cases: an event without id or moment, and a version without id or attribute,
    gives no row; a NULL event entity sees shared versions only; a repeated event row counts
    once; empty inputs give an empty result; other columns of the inputs are ignored, whatever
    they are called.
    """
    moment = moment if moment is not None else F.coalesce(F.col("date"), F.col("published_at"))
    ev = (
        events.select(F.col(event_id).cast("long").alias("e"), F.col(event_entity).cast("string").alias("ent"), F.unix_date(moment.cast("date")).alias("at"))
        .where(F.col("e").isNotNull() & F.col("at").isNotNull())
        .withColumn("ent", F.explode(F.array_distinct(F.array_compact(F.array(F.lit(shared), "ent")))))
        .dropDuplicates(["e", "ent", "at"])
        .withColumn("month", _month(F.col("at")))
    )
    number = F.nanvl(F.col(value).cast("double"), F.lit(None))
    ch = changes.select(
        F.col(change_id).cast("long").alias("v"),
        F.col(change_entity).cast("string").alias("ent"),
        F.col(attribute).cast("string").alias("attr"),
        (normalized_kind(F.col(kind)) == "known_future").alias("future"),
        F.coalesce(F.unix_date(F.col(valid).cast("date")), F.lit(_NO_DAY)).alias("ds"),
        F.unix_date(F.col(recorded).cast("date")).alias("rec"),
        number.alias("val"),
    ).where("v is not null and ent is not null and attr is not null and rec is not null and val is not null")
    ch = ch.withColumn("future", F.coalesce("future", F.lit(False))).where(f"not future or ds > {_NO_DAY}")
    ch = ch.withColumn("month", F.when(F.col("future"), _month(F.col("ds"))).otherwise(_month(F.col("rec"))))
    # of the versions recorded on one day (for one month, if they hold for a month) only the best can ever be the answer:
    # what is left of an entity is bounded by its attributes and days, however often they were revised
    best = F.max(F.struct("ds", (-F.col("v")).alias("nv"), "val")).alias("b")
    ch = ch.groupBy("ent", "attr", "future", "month", "rec").agg(best).select((-F.col("b.nv")).alias("v"), "ent", "attr", "future", "b.ds", "rec", "b.val", "month")
    ch = materialize(ch, "versions")

    counts = ev.groupBy("ent", "month").agg(F.count("*").alias("n_ev")).withColumn("n_ch", F.lit(0).cast("long"))
    counts = counts.unionByName(ch.groupBy("ent").agg(F.count("*").alias("n_ch")).select("ent", F.lit(None).cast("int").alias("month"), F.lit(0).cast("long").alias("n_ev"), "n_ch"))
    whole = Window.partitionBy("ent")  # a row per month of an entity
    slots = counts.withColumn("hot", F.sum(F.col("n_ev") + F.col("n_ch")).over(whole) > rows_per_group).where("n_ev > 0")
    slots = slots.withColumn("cut", F.when(F.col("hot"), F.col("month")).otherwise(F.lit(0)))
    slots = materialize(slots.select("ent", "month", "cut", "hot", F.ceil(F.sum("n_ev").over(Window.partitionBy("ent", "cut")) / rows_per_group).cast("int").alias("salts")), "slots")

    ev = ev.join(slots, ["ent", "month"]).withColumn("salt", F.pmod(F.xxhash64("e"), F.col("salts").cast("long")).cast("int")).select("ent", "cut", "salt", "e", "at")
    cuts = slots.select("ent", "cut", "salts", "hot").distinct()
    ch = ch.join(slots.select("ent", "hot").distinct(), "ent").withColumn("cut", F.when(F.col("hot"), F.col("month")).otherwise(F.lit(0)))
    overlap = _scopes_overlap(ch, shared)
    carry = _carried(ch.where("hot and not future"), cuts.where("hot"))
    ch = ch.drop("hot", "month").unionByName(carry).join(cuts.drop("hot"), ["ent", "cut"])
    ch = ch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("ent", "cut", "salt", "v", "attr", "future", "ds", "rec", "val")

    found = (
        ev.groupBy("ent", "cut", "salt")
        .cogroup(ch.groupBy("ent", "cut", "salt"))
        .applyInPandas(_search, "e long, attr string, v long, future boolean, ds int, rec int, val double")
    )
    if overlap:
        best = F.max_by(F.struct("v", "future", "ds", "rec", "val"), F.struct("ds", "rec", -F.col("v")))
        found = found.groupBy("e", "attr").agg(best.alias("b")).select("e", "attr", "b.*")
    day = lambda c: F.when(F.col(c) > _NO_DAY, F.date_from_unix_date(F.col(c)))
    return found.select(
        F.col("e").alias("event_id"), F.col("attr").alias("attribute"), F.col("v").alias("value_id"),
        F.when(F.col("future"), "known_future").otherwise("past_only").alias("kind"),
        day("ds").alias("valid_on"), day("rec").alias("recorded_on"), F.col("val").alias("value"),
    )


def _month(day: Column) -> Column:
    d = F.date_from_unix_date(day)
    return F.year(d) * 12 + F.month(d)


def _carried(history: DataFrame, slots: DataFrame) -> DataFrame:
    """For each month of a hot entity that has events: the best version of all earlier months."""
    best = history.groupBy("ent", "attr", "month").agg(F.max(F.struct("ds", "rec", (-F.col("v")).alias("nv"), "val")).alias("b"))
    marks = best.select("ent", "attr", "month", "b").unionByName(
        slots.select("ent", F.col("cut").alias("month")).join(best.select("ent", "attr").distinct(), "ent").select("ent", "attr", "month", F.lit(None).cast(best.schema["b"].dataType).alias("b"))
    )
    before = Window.partitionBy("ent", "attr").orderBy("month").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("c", F.max("b").over(before)).where("b is null and c is not null")
    return carried.select(
        (-F.col("c.nv")).alias("v"), "ent", "attr", F.lit(False).alias("future"), F.col("c.ds").alias("ds"), F.col("c.rec").alias("rec"), F.col("c.val").alias("val"), F.col("month").alias("cut"),
    )


def _scopes_overlap(ch: DataFrame, shared: str) -> bool:
    """Whether an attribute has both shared and own versions, so that two groups may answer."""
    own = ch.groupBy("attr").agg(F.max((F.col("ent") == shared).cast("int")).alias("s"), F.min((F.col("ent") == shared).cast("int")).alias("o"))
    return bool(own.where("s <> o").limit(1).count())


def _search(ev: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
    parts = []
    if len(ev) and len(ch):
        at = ev["at"].to_numpy(np.int64)
        at_month = at.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
        for (_, future), g in ch.groupby(["attr", "future"], sort=False):
            ds, rec, v = (g[c].to_numpy(np.int64) for c in ("ds", "rec", "v"))
            month = ds.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) if future else np.zeros(len(g), np.int64)
            base = month.min()
            span = 1 << 33
            stamp = (month - base) * span + (rec - _NO_DAY)
            wanted = (at_month - base if future else np.zeros(len(at), np.int64)) * span + (at - _NO_DAY)
            rank = np.empty(len(g), np.int64)
            rank[np.lexsort((-v, rec, ds, month))] = np.arange(len(g))
            order = np.argsort(stamp, kind="stable")
            best = np.maximum.accumulate(rank[order])
            by_rank = np.argsort(rank)
            pos = np.searchsorted(stamp[order], wanted, side="right") - 1
            hit = pos >= 0
            row = by_rank[best[np.where(hit, pos, 0)]]
            if future:
                hit &= month[row] == at_month
            if hit.any():
                r = g.iloc[row[hit]]
                parts.append(pd.DataFrame({"e": ev["e"].to_numpy()[hit], **{c: r[c].to_numpy() for c in ("attr", "v", "future", "ds", "rec", "val")}}))
    cols = ["e", "attr", "v", "future", "ds", "rec", "val"]
    if not parts:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(cols, ("int64", "object", "int64", "bool", "int32", "int32", "float64"))})
    out = pd.concat(parts, ignore_index=True)
    if out.duplicated(["e", "attr"]).any():  # an attribute that has both kinds of version
        out = out.sort_values(["ds", "rec", "v"], ascending=[True, True, False]).drop_duplicates(["e", "attr"], keep="last")
    return out[cols]
