"""Streams: admission with state, windows over logs, duplicates within a watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..defaults import Settings
from ..operators.admission import Counter


def admission_stream(requests: DataFrame, key: str = "session_id", scope: str = "session", settings: Settings | None = None) -> DataFrame:
    """(request_id, ts, key, admitted, reason) for one kind of key of a stream (request_id, ts, key), in UTC days.

    State of a key: its day, the day's count and the times of the last window. A batch's requests are taken by time.
    """
    s = settings or Settings()
    minute, daily = (s.ip_minute_limit, s.ip_daily_limit) if scope == "ip" else (s.session_minute_limit, s.session_daily_limit)
    seconds = s.rate_window_seconds
    kind = requests.schema["request_id"].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Counter()
        if state.exists:
            day, c.count, times = state.get
            c.day, c.times = day, deque(times)
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        told = []
        for ts in rows["ts"]:
            ms = int(ts.value // 1_000_000)
            told.append(c.admit(ms, str(ts.date()), minute, daily, seconds))
        state.update((c.day, c.count, list(c.times)))
        yield pd.DataFrame({"request_id": rows["request_id"], "ts": rows["ts"], "key": k[0], "admitted": [t is None for t in told], "reason": told})

    keyed = requests.select("request_id", "ts", F.col(key).cast("string").alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(step, f"request_id {kind}, ts timestamp, key string, admitted boolean, reason string", "day string, count int, times array<long>", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of windows over ts; works on a stream (late rows beyond the watermark go) and on a table."""
    w = F.window("ts", size, slide or size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(key, start, end, n) of sessions: runs of a key's events without a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_hash(rows: DataFrame, hash_col: str = "source_hash", late: str = "1 hour") -> DataFrame:
    """The first row of each hash: within the watermark on a stream, over all rows on a table."""
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([hash_col])
    first = rows.groupBy(hash_col).agg(F.min(F.struct("ts", *[c for c in rows.columns if c not in ("ts", hash_col)])).alias("r"))
    return first.select(hash_col, "r.*").select(*rows.columns)
