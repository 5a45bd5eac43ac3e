"""Streams that run to the end of what has arrived, with state that expires and sinks that a repeated batch leaves as they are."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..defaults import Settings
from ..operators.admission import REASONS, Counter

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that requests without an address or session are dealt to, and what other keys begin with.
FREE, DEALT, KEYED = "\0", 1024, "="
#: Columns that only an operator of admissions() needs.
OWN = ["ms", "day", "day_ends", "key"]
#: Groups that keys of a stream are dealt to; a call of Python costs as much for one key as for many.
BUCKETS = 4096


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """Inside, streams keep their state in files of the checkpoint and the local disk instead of the heap; timers need that."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a folder by its number, so a batch that is run again replaces what it wrote."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def run_available(rows: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that has arrived since the checkpoint's last run, and ends."""
    with state_in_files(rows.sparkSession):
        rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Admissions(StatefulProcessor):
    """Admission of one kind of key. State of a key: its day, the day's count, the times of the last window; it goes when the day is over and no row of it can come any more. Rows of free keys pass with the reason that they have."""

    def __init__(self, name: str, minute: int, daily: int, seconds: int, late_ms: int):
        self.name, self.minute, self.daily, self.seconds, self.late_ms = name, minute, daily, seconds, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", "day string, count int, ends long, times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith(FREE):
            for f in rows:
                yield self._told(f, f.get("reason"))
            return
        c, ends, old = Counter(), 0, None
        if self.state.exists():
            c.day, c.count, ends, times = self.state.get()
            c.times, old = deque(times), ends
        batch = pd.concat(list(rows)).sort_values(["ms", "request_id"])
        ms, day = batch["ms"].to_numpy(), batch["day"].to_numpy()
        starts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1), len(ms)]
        told = np.concatenate([c.admit_all(ms[i:j], str(day[i]), self.minute, self.daily, self.seconds) for i, j in pairwise(starts)])
        ends = max(ends, int(batch["day_ends"].max()))
        self.state.update((c.day, c.count, ends, list(c.times)))
        if ends != old:
            if old is not None:
                self.handle.deleteTimer(old + self.late_ms)
            self.handle.registerTimer(ends + self.late_ms)
        yield self._told(batch, np.array([r and f"{self.name}_{r}" for r in REASONS], object)[told])

    def _told(self, rows: pd.DataFrame, reason) -> pd.DataFrame:
        return rows.drop(columns=OWN, errors="ignore").assign(reason=reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _key(c: str, limited: Column) -> Column:
    """A key's day, as limits start anew each day; rows that aren't limited are dealt to keys of their own."""
    name = F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.when(limited & (name != ""), F.concat(F.lit(KEYED), name, F.lit(FREE), "day")).otherwise(F.concat(F.lit(FREE), F.pmod(F.xxhash64("request_id"), F.lit(DEALT)).cast("string")))


def admissions(requests: DataFrame, settings: Settings | None = None, zone: str = "UTC", late_hours: int = 24) -> DataFrame:
    """A stream's requests (request_id, ts, ip, session_id) with admitted and reason, as admission.decide() has them.

    The address's operator comes first; the session's decides on what that admits, and hands on what it turns away.
    Requests have to arrive in the order of their times from batch to batch; within a batch any order will do. Rows older
    than the newest by late_hours are dropped, as with any watermark. Requests without an address or session aren't
    limited by it. A task holds one key's rows of one day of one batch.
    """
    s = settings or Settings()
    late = late_hours * 3_600_000
    kind = requests.schema["request_id"].dataType.simpleString()
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    own = [F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), day.cast("string").alias("day"), F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)).alias("day_ends")]
    out = f"request_id {kind}, ts timestamp, ip string, session_id string, reason string"

    def step(rows: DataFrame, by: str, limited: Column, name: str, minute: int, daily: int) -> DataFrame:
        dealt = rows.select("*", *own).withColumn("key", _key(by, limited)).groupBy("key")
        return dealt.transformWithStateInPandas(Admissions(name, minute, daily, s.rate_window_seconds, late), out, "append", "eventTime", eventTimeColumnName="ts")

    r = requests.withWatermark("ts", f"{late_hours} hours").select("request_id", "ts", F.col("ip").cast("string").alias("ip"), F.col("session_id").cast("string").alias("session_id"))
    by_ip = step(r, "ip", F.lit(True), "IP", s.ip_minute_limit, s.ip_daily_limit)
    told = step(by_ip, "session_id", F.col("reason").isNull(), "SESSION", s.session_minute_limit, s.session_daily_limit)
    return told.select("request_id", "ts", "ip", "session_id", F.col("reason").isNull().alias("admitted"), "reason")


class Firsts(StatefulProcessor):
    """The first row of each hash, for the hashes of a bucket together: state and tables are handled once for a bucket, not for each hash. A hash is forgotten when its window has passed."""

    def __init__(self, window_ms: int, names: list[str]):
        self.window_ms, self.names = window_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "hashes array<string>, ms array<long>, due long")

    def _known(self, timerValues) -> tuple[dict[str, int], int | None]:
        """What is not forgotten yet, and when the timer is due."""
        if not self.seen.exists():
            return {}, None
        hashes, times, due = self.seen.get()
        now = timerValues.getCurrentWatermarkInMs()
        return {h: ms for h, ms in zip(hashes, times, strict=True) if ms + self.window_ms > now}, due

    def _keep(self, known: dict[str, int], due: int | None) -> None:
        first = min(known.values()) + self.window_ms if known else None
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        if known:
            self.seen.update((list(known), list(known.values()), first))
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, due = self._known(timerValues)
        order, best = ["ts", *[c for c in self.names if c != "ts"]], None
        for f in rows:
            own = f[~f["own_hash"].isin(list(known))]
            best = (own if best is None else pd.concat([best, own])).sort_values(order).drop_duplicates("own_hash")
        if best is not None and len(best):
            known.update(zip(best["own_hash"], map(int, best["own_ms"]), strict=True))
            self._keep(known, due)
            yield best[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(timerValues)[0], None)  # the timer that has run out is taken away by Spark
        return iter([])

    def close(self) -> None:
        pass


def first_rows(rows: DataFrame, hash_col: str = "source_hash", window_hours: int = 24 * 365, late_hours: int = 24) -> DataFrame:
    """Of a stream with ts, the earliest row of each hash, by batches in the order of time; a hash counts as new again when window_hours have passed."""
    names = rows.columns
    dealt = rows.withWatermark("ts", f"{late_hours} hours").select(
        *names, F.to_json(F.struct(hash_col)).alias("own_hash"), F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)).alias("own_ms"), F.pmod(F.xxhash64(hash_col), F.lit(BUCKETS)).alias("own_bucket"))
    return dealt.groupBy("own_bucket").transformWithStateInPandas(Firsts(window_hours * 3_600_000, names), rows.schema, "append", "eventTime", eventTimeColumnName="ts")
