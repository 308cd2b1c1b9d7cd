"""Causal detectors as stateful streaming operators.

The state of a series is a handful of numbers.  Rows that arrive out of order are held until the
watermark passes them: only then is their order final.  Held rows and sums live in the state store;
a replay of the stream gives the alarms of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "unique_id string, ts timestamp, kind string, statistic double"
_STATE = "pos double, neg double, mean double, cum double, low double, high double, n long, held_ts array<long>, held_x array<double>"


def _step(s: dict, x: float, cusum: float, drift: float, ph: float, delta: float) -> list[tuple[str, float]]:
    """Advance both detectors by one value; the alarms it raises."""
    out = []
    s["pos"], s["neg"] = max(0.0, s["pos"] + x - drift), max(0.0, s["neg"] - x - drift)
    if (stat := max(s["pos"], s["neg"])) > cusum:
        out.append(("cusum", stat))
        s["pos"] = s["neg"] = 0.0
    s["n"] += 1
    s["mean"] += (x - s["mean"]) / s["n"]
    s["cum"] += x - s["mean"] - delta
    s["low"], s["high"] = min(s["low"], s["cum"]), max(s["high"], s["cum"])
    if (stat := max(s["cum"] - s["low"], s["high"] - s["cum"])) > ph:
        out.append(("page_hinkley", stat))
        s["mean"] = s["cum"] = s["low"] = s["high"] = 0.0
        s["n"] = 0
    return out


def stream_alarms(stream: DataFrame, *, delay: str = "0 seconds", cusum: float = 5.0, drift: float = 0.5, page_hinkley: float = 5.0, delta: float = 0.05) -> DataFrame:
    """``unique_id, ts, kind, statistic`` alarms of a stream ``unique_id, ts, x``.

    Rows older than the watermark (``delay`` behind the latest time seen) were ruled out by it; equal
    times keep the order of their values.  NULL and NaN count as 0, as in the batch detectors.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("pos", "neg", "mean", "cum", "low", "high", "n", "held_ts", "held_x")
        s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names[:6], 0.0) | {"n": 0, "held_ts": [], "held_x": []}
        held = list(zip(s["held_ts"] or [], s["held_x"] or []))
        for pdf in batches:
            held += zip(pdf["us"].tolist(), pdf["x"].fillna(0.0).tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        held.sort()
        rows, rest = [], []
        for us, x in held:
            if us > mark and not state.hasTimedOut:
                rest.append((us, x))
                continue
            rows += [(key[0], pd.Timestamp(us, unit="us"), kind, stat) for kind, stat in _step(s, x, cusum, drift, page_hinkley, delta)]
        s["held_ts"], s["held_x"] = [u for u, _ in rest], [x for _, x in rest]
        state.update(tuple(s[c] for c in names))
        if rest:
            state.setTimeoutTimestamp(int(max(rest[-1][0] // 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(rows, columns=["unique_id", "ts", "kind", "statistic"])

    x = F.coalesce(F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    timed = stream.select("unique_id", "ts", F.unix_micros("ts").alias("us"), x.alias("x")).withWatermark("ts", delay)
    return timed.groupBy("unique_id").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, *, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Event counts and mean value per kind and window of knowledge time, late events by watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Process everything available into an in-memory table (tests and demonstrations)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
