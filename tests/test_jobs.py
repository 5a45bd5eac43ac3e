"""Streams of several runs over one checkpoint."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from lodestone import defaults
from lodestone.operators import admission
from lodestone.streaming import jobs

SETTINGS = defaults.Settings.of(ip_minute_limit=3, ip_daily_limit=9, session_minute_limit=2, session_daily_limit=5, rate_window_seconds=600)


def test_decisions_are_those_of_the_whole_table(spark, tmp_path):
    rnd, at = random.Random(3), datetime(2024, 3, 1, 20)
    rows = []
    for k in range(240):
        at += timedelta(seconds=rnd.choice([0, 20, 90, 400, 4000]))
        rows.append((k, at, rnd.choice(["a", "b", " a ", "", None]), rnd.choice(["s", "t", "u", None, "  "])))
    schema = "request_id long, ts timestamp, ip string, session_id string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).write.mode("append").parquet(src)
        told = jobs.admissions(spark.readStream.schema(schema).parquet(src), SETTINGS)
        jobs.run_available(told, jobs.batch_folder(out), str(tmp_path / "held"))
        jobs.run_available(told, jobs.batch_folder(out), str(tmp_path / "held"))  # nothing is new
    got = sorted(map(tuple, spark.read.parquet(out).select("request_id", "admitted", "reason").collect()))
    want = admission.decide(spark.createDataFrame(rows, schema), SETTINGS).select("request_id", "admitted", "reason")
    assert got == sorted(map(tuple, want.collect()))
    assert {r for *_, r in got} >= {None, "IP_MINUTE_LIMIT"} and len({r for *_, r in got}) > 2


class Handle:
    """What a processor sees of its key."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_a_key_is_forgotten_after_its_day():
    h, p = Handle(), jobs.Admissions("IP", 2, 5, 60, 1000)
    p.init(h)
    rows = lambda *ms: [pd.DataFrame({"request_id": range(len(ms)), "ms": ms, "day": [str(m // 100_000) for m in ms], "day_ends": [(m // 100_000 + 1) * 100_000 for m in ms]})]
    told = [f["reason"].tolist() for f in p.handleInputRows(("k",), rows(5, 1, 9), None)]
    assert told == [[None, None, "IP_MINUTE_LIMIT"]] and h.timers == {101_000}
    list(p.handleInputRows(("k",), rows(250_000), None))
    assert h.timers == {301_000} and h.value[0] == "2"
    assert list(p.handleExpiredTimer(("k",), None, None)) == [] and h.value is None
    free = jobs.Admissions("IP", 1, 1, 60, 1000)
    free.init(h)
    assert [f["reason"].tolist() for f in free.handleInputRows((jobs.FREE + "3",), rows(1, 2, 3), None)] == [[None] * 3] and h.value is None


def test_a_batch_that_is_run_again_writes_once(spark, tmp_path):
    src, out, held = (str(tmp_path / x) for x in ("in", "out", "held"))
    put = jobs.batch_folder(out)

    def breaks_off(batch, number):
        put(batch, number)
        raise RuntimeError("broken off")

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(src)
        rows = spark.readStream.schema("id long").parquet(src)
        if k == 1:
            with pytest.raises(StreamingQueryException):
                jobs.run_available(rows, breaks_off, held)
        jobs.run_available(rows, put, held)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_first_rows_of_two_runs(spark, tmp_path):
    src, out, held = (str(tmp_path / x) for x in ("in", "out", "held"))
    day = datetime(2024, 3, 1)
    parts = [[(1, day, "x"), (0, day, "x"), (2, day + timedelta(hours=1), "y")], [(3, day + timedelta(hours=2), "x"), (4, day + timedelta(hours=2), "z")]]
    for rows in parts:
        spark.createDataFrame(rows, "n long, ts timestamp, source_hash string").write.mode("append").parquet(src)
        jobs.run_available(jobs.first_rows(spark.readStream.schema("n long, ts timestamp, source_hash string").parquet(src)), jobs.batch_folder(out), held)
    assert sorted((r.source_hash, r.n) for r in spark.read.parquet(out).collect()) == [("x", 0), ("y", 2), ("z", 4)]
