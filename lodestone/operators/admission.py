"""Which requests a rate limiter lets in. A request that is turned away uses nothing up, so decisions depend on decisions.

Counters start anew each local day, so a key's days are independent. Rows are dealt by key and day, sorted, and read as
a stream: a task holds the times of a minute's admitted requests of one key, never a key's rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import Settings


#: What is said of a request.
REASONS = [None, "MINUTE_LIMIT", "DAILY_LIMIT"]


class Counter:
    """One key's admissions."""

    def __init__(self):
        self.day, self.count, self.times = None, 0, deque()

    def admit(self, millis: int, day, minute_limit: int, daily_limit: int, window_seconds: int) -> str | None:
        """Why the request is turned away, or None; an admitted request is counted. A limit of 0 is none."""
        if day != self.day:
            self.day, self.count = day, 0
            self.times.clear()
        while self.times and self.times[0] < millis - 1000 * max(1, window_seconds):
            self.times.popleft()
        if 0 < minute_limit <= len(self.times):
            return "MINUTE_LIMIT"
        if 0 < daily_limit <= self.count:
            return "DAILY_LIMIT"
        self.times.append(millis)
        self.count += 1
        return None

    def admit_all(self, millis: np.ndarray, day, minute_limit: int, daily_limit: int, window_seconds: int) -> np.ndarray:
        """What admit() says of each of one day's ascending times, as places in REASONS; a run of requests that are turned away is passed over at once."""
        told, i, window = np.zeros(len(millis), np.int8), 0, 1000 * max(1, window_seconds)
        while i < len(millis):
            why = self.admit(int(millis[i]), day, minute_limit, daily_limit, window_seconds)
            j = i + 1
            if why == "MINUTE_LIMIT":  # until so many have left the window that less than the limit are in it
                leaving = list(islice(self.times, len(self.times) - minute_limit + 1))
                j = max(j, int(np.searchsorted(millis, max(leaving) + window, "right")))
            elif why:  # until the day ends
                j = len(millis)
            told[i:j] = REASONS.index(why)
            i = j
        return told


def fold(requests: DataFrame, key: str, minute_limit: int, daily_limit: int, window_seconds: int, out: str) -> DataFrame:
    """requests (request_id, ts, day, ...) with column out: the reason, null if admitted; blank keys are always admitted."""
    schema = requests.schema
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    free = requests.filter(blank).withColumn(out, F.lit(None).cast("string"))
    keyed = requests.filter(~blank)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.withColumn("_key", F.trim(key)).withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp"))).repartition(n, "_key", "day").sortWithinPartitions("_key", "day", "ts", "request_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, counter = None, Counter()
        for f in frames:
            told = []
            for k, day, ms in zip(f["_key"], f["day"], f["_ms"], strict=True):
                if k != last:
                    last, counter = k, Counter()
                told.append(counter.admit(int(ms), day, minute_limit, daily_limit, window_seconds))
            yield f[schema.names].assign(**{out: pd.Series(told, index=f.index, dtype=object)})

    names = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
    return dealt.mapInPandas(run, f"{names}, {out} string").unionByName(free)


def decide(requests: DataFrame, settings: Settings | None = None, zone: str = "UTC") -> DataFrame:
    """requests (request_id, ts, ip, session_id) with admitted and reason.

    The address is counted before the session is looked at: a request that its session turns away has used up its
    address's place. Blank addresses and sessions aren't limited.
    """
    s = settings or Settings()
    r = requests.select("request_id", "ts", "ip", "session_id").withColumn("day", F.to_date(F.from_utc_timestamp("ts", zone)))
    by_ip = fold(r, "ip", s.ip_minute_limit, s.ip_daily_limit, s.rate_window_seconds, "ip_reason")
    passed = fold(by_ip.filter("ip_reason is null").drop("ip_reason"), "session_id", s.session_minute_limit, s.session_daily_limit, s.rate_window_seconds, "reason")
    reason = lambda scope, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(scope), F.col(c)))
    a = by_ip.filter("ip_reason is not null").withColumn("reason", reason("IP_", "ip_reason")).drop("ip_reason")
    b = passed.withColumn("reason", reason("SESSION_", "reason"))
    return a.unionByName(b).select("request_id", "ts", "ip", "session_id", F.col("reason").isNull().alias("admitted"), "reason")


def cooldown(requests: DataFrame, seconds: int = 300, key: str = "index_name") -> DataFrame:
    """requests (request_id, ts, key) with accepted: one that comes within the cooldown of the last accepted isn't.

    Times count in milliseconds, rounded to the nearest. A request without a time isn't accepted and holds none back; of those without a key
    the first is. Columns pass as they are, whatever the session's zone; a task reads its keys as a stream.
    """
    r = requests.select("request_id", "ts", F.col(key).cast("string").alias("key"))
    kind = r.withColumn("accepted", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for b in batches:
            us = b.column(1).cast(pa.int64())
            x, told = us.fill_null(0).to_numpy(), []
            millis = pa.array(np.sign(x) * ((np.abs(x) + 500) // 1000), mask=us.is_null().to_numpy(zero_copy_only=False))
            for k, ms in zip(b.column(2).to_pylist(), millis.to_pylist(), strict=True):
                if k != last:
                    last, at = k, None
                ok = ms is not None and (at is None or (k is not None and ms - at >= 1000 * seconds))
                at = ms if ok else at
                told.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.bool_())], kind.names)

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = r.repartition(n, "key").sortWithinPartitions("key", "ts", F.asc_nulls_last("request_id"))
    return dealt.mapInArrow(run, kind).withColumnRenamed("key", key)
