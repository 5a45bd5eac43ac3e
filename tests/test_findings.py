"""What reviewers found: each test failed before the change that it came with."""

import hashlib
import math
import os
import subprocess
import sys
import uuid
from collections import Counter
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import catalog, catalog_tables, defaults  # noqa: F401 - the second adds its SQL to the first
from lodestone.functions import text, vectors
from lodestone.operators import admission, dense, lexical, provenance, web
from lodestone.sources import readers, sinks, sqlite
from lodestone.streaming import jobs
from lodestone.tables import stored


def test_a_request_without_a_time_holds_none_back(spark):
    rows = [(2**60 + k, None if s is None else datetime(2026, 1, 1) + timedelta(seconds=s), "x") for k, s in enumerate((None, 0, 299, 300))] + [(None, None, None)]
    r = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, index_name string")
    got = {x.request_id: x.accepted for x in admission.cooldown(r).collect()}
    assert got == {2**60: False, 2**60 + 1: True, 2**60 + 2: False, 2**60 + 3: True, None: False}


def test_a_cooldown_does_not_hang_on_the_zone(spark):
    r = spark.createDataFrame([(k, datetime(2026, 3, 8, 1, 30) + timedelta(minutes=m), "x") for k, m in enumerate((0, 60, 119, 120))], "request_id long, ts timestamp_ntz, index_name string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [(x.ts, x.accepted) for x in admission.cooldown(r, 3600).orderBy("request_id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(datetime(2026, 3, 8, 1, 30) + timedelta(minutes=m), ok) for m, ok in ((0, True), (60, True), (119, False), (120, True))]


def test_a_cooldown_counts_rounded_milliseconds(spark, tmp_path):
    """As epoch_ms of SQL does; of requests at one time, one without an id comes last."""
    hour, rnd = 3600 * 10**6, np.random.default_rng(4)
    us = [int(x) for x in rnd.integers(-20, 40, 2000) * hour // 2 + rnd.integers(-1000, 1000, 2000)]
    rows = [(k if k % 9 else None, datetime(1970, 1, 1) + timedelta(microseconds=x), k % 7) for k, x in enumerate(us)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = Counter(tuple(r) for r in catalog.reindex_cooldown(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == Counter(db.sql(catalog.SQL["reindex_cooldown"]).fetchall())


def documents(spark, folder, texts):
    """A table of documents, and a function that says whether a query over it gives what its SQL does."""
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return lambda name: Counter(tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()) == Counter(db.sql(catalog.SQL[name]).fetchall())


@pytest.mark.parametrize("texts", [["a", "", "bc", "", "", "ü", None, None, "x" * 3000], ["", "", ""], ["a", "b"]])
def test_empty_files_are_counted(spark, tmp_path, texts):
    assert documents(spark, tmp_path, texts)("files_by_kind")


def test_empty_files_are_within_a_limit(spark, tmp_path):
    """A document without a text has no file."""
    assert documents(spark, tmp_path, ["a", "", "", None, "ü" * 1000, "ü" * 1001, "x" * 2000])("files_within_a_limit")


def test_empty_files_are_found(spark, tmp_path):
    """With the names they have, and beside files that aren't empty."""
    top = tmp_path / "top"
    (top / "a b").mkdir(parents=True)
    for name, text in (("a b/c d.txt", ""), ("é%20+,.md", ""), ("x.md", "x"), ("no.bin", "")):
        (top / name).write_text(text)
    scan = lambda **o: {r.path: (bytes(r.content), r.length) for r in readers.glob_scan(spark, str(top), **o).collect()}
    empty = {f"file:{top}/{n}": (b"", 0) for n in ("a b/c d.txt", "é%20+,.md")}
    assert scan() == empty | {f"file:{top}/x.md": (b"x", 1)} and scan(max_bytes=0) == empty and scan(pattern="x*") == {f"file:{top}/x.md": (b"x", 1)}
    assert {(r.path, r.text) for r in readers.markdown_documents(spark, str(top)).collect()} == {(f"file://{top}/a%20b/c%20d.txt", ""), (f"file://{top}/é%2520+,.md", ""), (f"file://{top}/x.md", "x")}


def test_vectors_are_compared_as_columns(spark):
    """Those of one length; the others as arrays, with the same results."""
    rnd = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rnd.normal(size=8)]) for k in range(60)] + [(60, None), (61, []), (62, [1.0] * 5), (63, [0.0] * 8), (64, [None] + [1.0] * 7), (65, [1.0] * 9)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.filter("id % 10 < 6").withColumnRenamed("id", "query_id")
    got = dense.search_by_expression(v, q, 70)
    a = v.crossJoin(q.select("query_id", F.col("embedding").alias("q"))).withColumn("score", vectors.cosine(F.col("embedding"), F.col("q")))
    want = lexical.top_k(a, 70, rank="dense_rank").select("query_id", "id", "score", "dense_rank")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    told = v.filter("id < 60").transform(lambda x: dense.search_by_expression(x, q, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "(v7#" in told and "(v8#" not in told


def test_one_page_is_held_at_a_time(monkeypatch):
    held, most = set(), []

    class Counted(web.Page):
        def __init__(self, html):
            super().__init__(html)
            held.add(id(self))
            most.append(len(held))

        def __del__(self):
            held.discard(id(self))

    monkeypatch.setattr(web, "Page", Counted)
    got = web.notice_parts.func(pd.Series(["<p>a</p>", None, "<p>b</p><a href='/c.pdf'>x</a>"] * 20), pd.Series(["http://h/", None, "http://h/"] * 20))
    assert list(got["text"][:3]) == ["a", "", "b\nx"] and list(got["files"][:3]) == [[], [], ["http://h/c.pdf"]] and max(most) <= 2


def test_extracted_pages_are_passed_on_as_they_come(spark):
    one = spark.createDataFrame([(f"f{k}", b"x;" * 5000 + b" ;last") for k in range(3)], "path string, content binary").coalesce(1)
    sizes = []
    readers_out = readers.pdf_sections(one, lambda b: b.decode().split(";"))
    sizes = readers_out.mapInArrow(lambda bs: bs, readers_out.schema).rdd.glom().map(len).collect()
    assert sum(sizes) == 3 * 5001
    got = readers_out.filter("path = 'f1'").agg(F.count("*"), F.max("page"), F.max_by("text", "page")).first()
    assert tuple(got) == (5001, 5002, "last")


def test_patterns_that_are_left_out_change_nothing(spark):
    rows = ["", None, " ", "a", "a  b\t c\r\n\n\n\nd ", "\t", "x\ty", "# h\nt", "_a_", "é é", " \n" * 700 + "w " * 95, "w " * 800, "ab " * 59 + "abc" + " " * 900 + "d", "z" * 181, "z" * 180 + " " * 1000]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, t string")
    c = F.col("t")
    normal = text.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r", ""), "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))
    flat = text.collapse(c)
    short = F.when(F.length(flat) > 180, F.concat(F.substring(flat, 1, 180), F.lit("..."))).otherwise(flat)
    for r in t.select("k", text.normalize(c).alias("a"), normal.alias("b"), text.snippet(c).alias("d"), short.alias("e")).collect():
        assert r.a == r.b and r.d == r.e, r
    plan = t.select(text.normalize(c))._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()


def test_norms_are_computed_once_for_each_vector(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, []), (5, None), (6, [3.0, 4.0]), (7, [1.0, None])], "id int, embedding array<float>")
    found = dense.search_by_expression(v, v.filter("id = 6").select(F.col("id").alias("query_id"), "embedding"), 9)
    assert [(r.id, r.dense_score) for r in found.orderBy("dense_rank").collect()] == [(6, 1.0), (1, 0.6), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0), (7, 0.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Cross")]
    assert above.count("aggregate(zip_with(") == 1, plan


def test_texts_are_counted_in_slices(spark):
    n = 2 * lexical.ROWS + 100
    t = spark.range(n).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("a a b"), F.col("id").cast("string"))).alias("text")).coalesce(1)
    got = {r.id: (r.dl, sorted(zip(r.terms, r.tfs))) for r in lexical.counted(t, "id", "text").collect()}
    assert got == {k: (3, [("a", 2), (f"b{k}", 1)]) if k % 7 else (0, []) for k in range(n)}


@pytest.mark.parametrize("handed_on", [True, False])
def test_the_hash_of_a_corpus_is_handed_from_range_to_range(spark, monkeypatch, handed_on):
    ranges = []
    monkeypatch.setattr(provenance, "RANGE_BYTES", 100)
    monkeypatch.setattr(provenance, "stored", lambda df, *a, **k: ranges.append(stored(df, *a, **k)) or ranges[-1])
    monkeypatch.setattr(provenance, "dropped", lambda *t: None)
    if not handed_on:
        monkeypatch.setattr(provenance.sha, "can_hand_on", lambda: False)
    texts = [(d, None if d == 3 else f"Titel {d}", "p", "md", s, f"s{s}", s or None, "가" * 7 * d if d % 4 else "") for d in range(9) for s in range(5)]
    sec = spark.createDataFrame(texts[::-1], "document_id int, title string, path string, content_type string, section_index int, section string, page int, text string")
    want, last = [], None
    for d, title, path, kind, _, section, page, text in texts:
        want += ([title, path, kind] if d != last else []) + [section, "null" if page is None else str(page), text]
        last = d
    assert provenance.corpus_hash(sec).first()[0] == hashlib.sha256("".join(p + "\0" for p in want if p is not None).encode()).hexdigest()
    if handed_on:
        rows = [r["count"] for r in ranges[0].groupBy("_range").count().collect()]
        assert len(rows) > 3 and max(rows) < 15
    none = sec.filter("false")
    assert provenance.corpus_hash(none).first()[0] == hashlib.sha256().hexdigest()


def test_small_files_are_written_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    looked = tmp_path / "looked"
    looked.mkdir()
    rows = [(f"{k % 3}/n{k}.md", f"---\ntitle: T{k}\nurl: u{k}\n---\n가 {k}\n") for k in range(700)] + [("x.txt", "."), ("y.log", "# no")]
    resolve = sinks.Path.resolve

    def told(self, *a):
        (looked / uuid.uuid4().hex).touch()
        return resolve(self, *a)

    put = {}
    monkeypatch.setattr(sinks.Path, "resolve", told)
    sinks.write_files(SimpleNamespace(select=lambda *c: SimpleNamespace(foreachPartition=lambda f: put.update(f=f))), str(tmp_path / "files"))
    put["f"](iter(rows))
    assert len(list(looked.iterdir())) < 20
    for bad in ("/x.md", "../x.md", "1/../../x.md", "..", "1/..", ""):
        with pytest.raises(ValueError, match="lies outside"):
            put["f"](iter([("a.log", ""), (bad, "")]))
    (tmp_path / "files" / "link.md").symlink_to(tmp_path / "outside.md")
    with pytest.raises(ValueError, match="lies outside"):
        put["f"](iter([("link.md", "x")]))
    (tmp_path / "files" / "link.md").unlink()
    t = readers.markdown_documents(spark, str(tmp_path / "files"))
    assert t.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = {r.document_id: (r.title, r.url, r.text, r.path.startswith("file:///")) for r in t.collect()}
    assert got == {f"n{k}": (f"T{k}", f"u{k}", f"\n가 {k}\n", True) for k in range(700)} | {"x": ("x", None, ".", True)}


def test_hashes_of_a_bucket_are_seen_in_one_call():
    kept, timers = {}, set()
    state = SimpleNamespace(exists=lambda: "v" in kept, get=lambda: kept["v"], update=lambda v: kept.update(v=v), clear=kept.clear)
    f = jobs.Firsts(100, ["ts", "h"])
    f.init(SimpleNamespace(getValueState=lambda *a: state, registerTimer=timers.add, deleteTimer=timers.remove))
    frame = lambda *rows: pd.DataFrame([(ms, h, f"[{h}]", ms) for h, ms in rows], columns=["ts", "h", "own_hash", "own_ms"])
    seen = lambda now, *frames: [tuple(r) for t in f.handleInputRows((0,), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: now)) for r in t.itertuples(index=False)]
    assert seen(0, frame(("a", 5), ("b", 3), ("a", 4)), frame(("b", 2), ("c", 9))) == [(2, "b"), (4, "a"), (9, "c")] and timers == {102}
    assert seen(50, frame(("a", 60), ("d", 61))) == [(61, "d")] and timers == {102}
    assert seen(103, frame(("b", 110), ("a", 110))) == [(110, "b")] and timers == {104}
    timers.clear()
    list(f.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 200), None))
    assert kept["v"][0] == ["[b]"] and timers == {210}


@pytest.mark.parametrize("profile", ["offline", "online"])
def test_a_sparse_embedding_is_dealt_once_and_by_rows(spark, profile):
    rows = [(1, "alpha beta alpha 가나"), (1, "beta gamma"), (2, ""), (3, None), (None, "delta"), (None, "delta x")]
    e = vectors.sparse_embedding(spark.createDataFrame(rows, "k long, t string"), "k", "t", profile, 16)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
    assert e._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    tokens = (vectors.evidence_tokens if profile == "online" else vectors.alnum_tokens)(F.col("t"))
    bucket, sign = vectors.bucket_and_sign(F.col("w"), profile, 16)
    want = {}
    for r in spark.createDataFrame(rows, "k long, t string").select("k", F.explode(tokens).alias("w")).select("k", bucket.alias("b"), sign.alias("s")).collect():
        want[r.k, r.b] = want.get((r.k, r.b), 0.0) + r.s
    norm = {k: sum(x * x for (i, _), x in want.items() if i == k) ** 0.5 for k, _ in want}
    assert {(r.id, r.bucket): round(r.weight, 9) for r in e.collect()} == {(k, b): round(x / norm[k], 9) for (k, b), x in want.items() if x}


def test_tasks_of_other_processes_reach_the_database(tmp_path):
    code = f"""
from lodestone.session import session
from lodestone import catalog, catalog_tables
s = session("local-cluster[2,1,1024]", 2, **{{"spark.executor.memory": "600m", "spark.checkpoint.dir": "file://{tmp_path}", "spark.driver.host": "127.0.0.1"}})
got = catalog.QUERIES["jdbc_table"](s, "/root/testdata/sf0.001")
want = s.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr("c_custkey", "cast(c_nationkey as long) c_nationkey", "round(c_acctbal, 2) c_acctbal")
assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
s.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_database_gives_what_it_was_given(spark, tmp_path, monkeypatch):
    rows = [(None, 1, 0.5, True, "NaN", b"x"), (2**62, None, float("nan"), None, None, None), (5, -1, float("-inf"), False, "\0가'", b""), (5, -1, None, False, "", b"\0")]
    df = spark.createDataFrame(rows * 5, 'a long, `b"c` int, d double, e boolean, f string, g binary')
    path = str(tmp_path / "new" / "db")
    for _ in range(2):
        sqlite.write_sqlite(df.repartition(3), path, "t x")
    monkeypatch.setattr(sqlite, "ROWS", 9)
    monkeypatch.setattr(sqlite, "BATCH", 3)
    back = sqlite.sqlite_scan(spark, path, "t x", df.schema, 2)
    assert back.rdd.getNumPartitions() == 5 and back.schema == df.schema
    told = lambda rs: sorted(repr([("nan" if isinstance(x, float) and math.isnan(x) else bytes(x) if isinstance(x, bytearray) else x) for x in r]) for r in rs)
    assert told(back.collect()) == told(rows * 10)
    sqlite.write_sqlite(df.limit(0), path, "none")
    assert sqlite.sqlite_scan(spark, path, "none", df.schema, 2).count() == 0
    with pytest.raises(ValueError, match="h date"):
        sqlite.write_sqlite(spark.sql("SELECT current_date() AS h"), path, "t")


def test_a_task_that_is_run_again_adds_nothing_twice(tmp_path, monkeypatch):
    put = []
    df = SimpleNamespace(schema=[], columns=["a"], foreachPartition=put.append)
    monkeypatch.setattr(sqlite, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    for _ in range(2):
        sqlite.write_sqlite(df, str(tmp_path / "db"), "t")
    for f in (put[0], put[0], put[1]):
        f(iter([(1,), (2,)]))
    with sqlite._opened(str(tmp_path / "db")) as db:
        assert [x for (x,) in db.execute("SELECT a FROM t ORDER BY rowid")] == [1, 2, 1, 2]


def test_jdbc_writes_and_reads_by_several_connections(spark):
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    sinks.write_jdbc(spark.range(100).withColumn("v", F.col("id") / 4), url, "t")
    back = readers.jdbc_scan(spark, url, "t", ("id", 0, 100, 3))
    assert back.rdd.getNumPartitions() == 3 and sorted((r.id, r.v) for r in back.collect()) == [(k, k / 4) for k in range(100)]


def test_requests_that_are_turned_away_are_passed_over(monkeypatch):
    rnd = np.random.default_rng(5)
    for _ in range(300):
        minute, daily, seconds = (int(rnd.integers(0, 5)), int(rnd.integers(0, 9)), int(rnd.integers(0, 4)))
        one, all_, want, got = admission.Counter(), admission.Counter(), [], []
        for day in ("a", "a", "b"):  # the second batch of a day may begin before the first ended
            ms = np.sort(rnd.integers(0, 9000, int(rnd.integers(0, 40))))
            want += [one.admit(int(x), day, minute, daily, seconds) for x in ms]
            got += [admission.REASONS[k] for k in all_.admit_all(ms, day, minute, daily, seconds)]
        assert got == want
    calls, admit = [], admission.Counter.admit
    monkeypatch.setattr(admission.Counter, "admit", lambda *a: calls.append(a) or admit(*a))
    assert (admission.Counter().admit_all(np.arange(200_000), "a", 2, 30, 1) == 0).sum() == 30
    assert len(calls) < 100


def test_addresses_are_looked_at_once_and_by_days(spark, tmp_path, monkeypatch):
    schema, src = "request_id long, ts timestamp, ip string, session_id string", str(tmp_path / "in")
    rows = [(k, datetime(2024, 3, 1 + k // 2), "a", None if k else " ") for k in range(6)] + [(6, datetime(2024, 3, 1), "\0", "s"), (7, datetime(2024, 3, 1), "\0", "t")]
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    s = defaults.Settings.of(ip_minute_limit=1)
    told = jobs.admissions(stream, s)
    assert told._jdf.queryExecution().analyzed().toString().count("TransformWithState") == 2
    keys = spark.read.parquet(src).withColumn("day", F.to_date("ts").cast("string")).select(jobs._key("ip", F.lit(True)).alias("key")).distinct()
    assert keys.count() == 4 and not [r for r in keys.collect() if r.key.startswith(jobs.FREE)]
    jobs.run_available(told, jobs.batch_folder(str(tmp_path / "out")), str(tmp_path / "held"))
    got = {r.request_id: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: "IP_MINUTE_LIMIT" if k % 2 else None for k in range(8)}
