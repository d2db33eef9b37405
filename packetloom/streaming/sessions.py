"""Sessions of streams as state: packets and time span of each conversation, given out when it ends or falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "key string, packets long, first timestamp, last timestamp, ended boolean"


def sessions(rows: DataFrame, key: Column, event_time: str, ends: Column, late: str = "10 minutes", silence: int = 60_000) -> DataFrame:
    """One row for each session of a key: it ends with a packet that says so, or after `silence` milliseconds of event time."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            yield pd.DataFrame([(k[0], n, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), False)], columns=["key", "packets", "first", "last", "ended"])
            return
        n, first, last = state.get if state.exists else (0, 0, 0)
        out = []
        got = pd.concat(list(batches)).sort_values("t")
        for t, end in zip(got["t"], got["e"], strict=True):
            us = int(t.value // 1000)
            n, first, last = n + 1, min(first, us) if n else us, max(last, us)
            if end:
                out.append((k[0], n, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), True))
                n, first, last = 0, 0, 0
        if n:
            state.update((n, first, last))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + silence)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "packets", "first", "last", "ended"])

    given = rows.withWatermark(event_time, late).select(key.cast("string").alias("key"), F.col(event_time).alias("t"), ends.alias("e"))
    return given.groupBy("key").applyInPandasWithState(step, SESSION, "n long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_windows(rows: DataFrame, key: str, event_time: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions where no packet says that it is the last: closed by a gap of event time."""
    g = rows.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("packets"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets")


def stop_all(spark: SparkSession) -> int:
    """Stop the session's running queries; how many there were."""
    running = spark.streams.active
    for q in running:
        q.stop()
    return len(running)


def metrics(query) -> dict:
    """Rows a second in and out, latency of the last batch and rows that came too late."""
    p = query.lastProgress or {}
    get = p.get if isinstance(p, dict) else lambda k, d=None: getattr(p, k, d)
    late = sum(s.get("numRowsDroppedByWatermark", 0) for s in get("stateOperators", None) or [])
    return {"in_per_second": get("inputRowsPerSecond", 0.0), "out_per_second": get("processedRowsPerSecond", 0.0), "latency_ms": (get("durationMs", None) or {}).get("triggerExecution", 0), "dropped_late": late}
