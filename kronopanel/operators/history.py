"""History of changing entity attributes by tree-reduction coalescing.

Every snapshot or update is a unit interval of its entity: it holds from its own start up to the
next one.  Neighbouring intervals with equal payload are one run.  The intervals are range-sorted
by (entity, start); each sorted block coalesces its own neighbours and keeps just two runs open,
the one on its left edge and the one on its right edge.  Blocks are then merged pairwise, in
log2(blocks) rounds, until one is left.  An open run is all a block passes on, so an entity that
holds a third of all rows costs each round no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date, squash_name
from kronopanel.session import materialize, shuffle_width

OPEN_END = "9999-12-31"

#: A run: closed ones are final.  ``edge`` is 'f' (block's first), 'l' (last), 's' (its only run) or 'c'.
_RUN = "block int, edge string, ent string, payload string, since int, until int"
_COLS = ["block", "edge", "ent", "payload", "since", "until"]
_OPEN = 2**31 - 1


def coalesce_runs(intervals: DataFrame, *, entity: str, start: str, payload: str, blocks: int | None = None) -> DataFrame:
    """Maximal runs ``entity, payload, valid_from, valid_to`` of equal payload.

    ``intervals`` has one row per (entity, start): the payload from that date on.  A NULL payload
    is a gap: it ends a run and opens none.  ``valid_to`` is exclusive, NULL while open.

    Defined edge cases: rows without entity or start are left out; rows that repeat an
    (entity, start) count once (the largest payload holds); an empty table gives an empty result.
    """
    n = blocks or shuffle_width(intervals.sparkSession)
    rows = intervals.select(F.col(entity).cast("string").alias("ent"), F.unix_date(F.col(start).cast("date")).alias("since"), F.col(payload).cast("string").alias("payload"))
    rows = rows.where("ent is not null and since is not null").groupBy("ent", "since").agg(F.max("payload").alias("payload"))
    leaves = rows.repartitionByRange(n, "ent", "since").sortWithinPartitions("ent", "since").mapInPandas(_leaf, _RUN)
    leaves = materialize(leaves, "runs")
    level = leaves.where("edge <> 'c'")
    size = 1
    while size < n:
        size *= 2
        level = level.withColumn("pair", F.floor(F.col("block") / size).cast("int")).groupBy("pair").applyInPandas(_merge, _RUN)
    done = leaves.where("edge = 'c'").unionByName(level).where("payload is not null")
    return done.select(
        F.col("ent").alias(entity), F.col("payload").alias(payload), F.date_from_unix_date("since").alias("valid_from"),
        F.when(F.col("until") < _OPEN, F.date_from_unix_date(F.col("until"))).alias("valid_to"),
    )


def history_from_snapshots(snapshots: DataFrame, *, entity: str, taken_on: str, payload: str) -> DataFrame:
    """Versions from periodic snapshots; an entity missing from a snapshot is absent from then on.

    Every snapshot date is known to every entity through the distinct dates, a list as long as the
    time axis: an entity's unit interval ends at the next snapshot, so a missing one leaves a gap.
    """
    taken = snapshots.select(F.col(entity).cast("string").alias(entity), F.col(taken_on).cast("date").alias("d"), F.col(payload).cast("string").alias(payload)).where(f"d is not null and `{entity}` is not null")
    days = taken.select("d").distinct()
    upto = days.select("d", F.lead("d").over(Window.orderBy("d")).alias("d2"))  # one row per snapshot
    unit = taken.join(upto, "d")
    starts = unit.select(entity, "d", payload, F.lit(1).alias("real"))
    ends = unit.where("d2 is not null").select(entity, F.col("d2").alias("d"), F.lit(None).cast("string").alias(payload), F.lit(0).alias("real"))
    marks = starts.unionByName(ends).groupBy(entity, "d").agg(F.max_by(payload, F.struct("real", payload)).alias(payload))
    return coalesce_runs(marks, entity=entity, start="d", payload=payload)


def history_from_acts(
    feed: DataFrame,
    *,
    entity: str = "predecessor",
    payload: str = "successor",
    effective: str = "effective",
    act: str = "source",
    recorded: str = "recorded_at",
    record_id: str = "reorg_id",
    name: Column | None = None,
) -> DataFrame:
    """History of an attribute from a feed of acts with corrections.

    Records with equal entity and act are versions of one act and the last recorded one holds (then
    the largest id); a record without act stands for itself.  Of several acts on one date the last
    recorded one holds.  An act that names the payload in force starts nothing new; an act without
    payload ends the period.  Names are lower-cased, trimmed, single-blanked; blank means NULL.

    Defined edge cases: a record without entity, and an act whose date cannot be read, is left out;
    repeated records count once; an empty feed gives an empty result; other columns are ignored.
    """
    clean = lambda c: F.when(squash_name(F.col(c)) != "", squash_name(F.col(c)))
    rec = F.struct(F.col(recorded).alias("at"), F.col(record_id).alias("id"))
    records = feed.select(clean(entity).alias("ent"), clean(payload).alias("payload"), flexible_date(F.col(effective)).alias("since"), F.coalesce(F.concat(F.lit("a"), F.trim(act)), F.concat(F.lit("r"), F.col(record_id).cast("string"))).alias("act"), rec.alias("rec")).where("ent is not null")
    acts = records.groupBy("ent", "act").agg(F.max_by(F.struct("since", "payload", "rec"), "rec").alias("v")).select("ent", "v.*").where("since is not null")
    dated = acts.groupBy("ent", "since").agg(F.max_by("payload", "rec").alias("payload"))
    return coalesce_runs(dated.withColumnRenamed("ent", entity).withColumnRenamed("payload", payload), entity=entity, start="since", payload=payload)


def _frame(block: int, runs: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(block, *r) for r in runs], columns=_COLS).astype({"block": "int32", "since": "int32", "until": "int32"})


def _leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coalesce one sorted block; the left and right edge runs stay open."""
    block = TaskContext.get().partitionId()
    first, last = None, None  # (ent, payload, since, until)
    for pdf in batches:
        if not len(pdf):
            continue
        ent, since = pdf["ent"].to_numpy(object), pdf["since"].to_numpy(np.int64)
        pay = pdf["payload"].astype(object).where(pdf["payload"].notna(), None).to_numpy(object)
        if last is not None:
            ent, since, pay = np.concatenate(([last[0]], ent)), np.concatenate(([last[2]], since)), np.concatenate((np.array([last[1]], object), pay))
        new = np.ones(len(ent), bool)
        new[1:] = (ent[1:] != ent[:-1]) | (pay[1:] != pay[:-1])
        ent, since, pay = ent[new], since[new], pay[new]
        until = np.where(ent[1:] == ent[:-1], since[1:], _OPEN)
        runs = [(e, p, int(s), int(u)) for e, p, s, u in zip(ent[:-1], pay[:-1], since[:-1], until)]
        if first is None and runs:
            first = runs.pop(0)
            yield _frame(block, [("f", *first)])
        if runs:
            yield _frame(block, [("c", *r) for r in runs])
        last = (ent[-1], pay[-1], int(since[-1]), _OPEN)
    if last is not None:
        yield _frame(block, [("s" if first is None else "l", *last)])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Join the blocks of a pair: at most two, each with its open edges and its closed runs."""
    out = pdf[pdf["edge"] == "c"]
    runs: list[list] = []
    open_rows = pdf[pdf["edge"] != "c"].copy()
    open_rows["order"] = open_rows["edge"].map({"f": 0, "s": 0, "l": 1})
    for r in open_rows.sort_values(["block", "order"]).itertuples(index=False):
        pay = r.payload if isinstance(r.payload, str) else None
        if runs and runs[-1][5] != r.block and runs[-1][0] == r.ent:  # the seam between two blocks
            if runs[-1][1] == pay:
                runs[-1][3], runs[-1][4] = int(r.until), runs[-1][4] and r.edge == "s"
                runs[-1][5] = r.block
                continue
            runs[-1][3] = int(r.since)
        runs.append([r.ent, pay, int(r.since), int(r.until), r.edge == "s", r.block])
    if not runs:
        return out[_COLS]
    block = int(open_rows["block"].min())
    if len(runs) == 1:
        edges = [("s", *runs[0][:4])]
    else:
        edges = [("f", *runs[0][:4]), *[("c", *x[:4]) for x in runs[1:-1]], ("l", *runs[-1][:4])]
    return pd.concat([out[_COLS], _frame(block, edges)], ignore_index=True)
