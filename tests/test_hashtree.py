"""Trees of hashes, and tables in buckets."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hashtree, store

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_plain_python(rows, leaf, fan):
    level, out = {}, []
    for i, d in sorted(rows):
        level.setdefault(i // leaf, []).append((i, d, 1))
    while level:
        nodes = {n: (sha("".join(f"{i}:{d}\n" for i, d, _ in own)), sum(c for *_, c in own)) for n, own in level.items()}
        k = out[-1][0] + 1 if out else 0
        out += [(k, n, c, d) for n, (d, c) in nodes.items()]
        if len(nodes) == 1:
            break
        level = {}
        for n in sorted(nodes):
            up = 0 if set(nodes) <= {-1, 0} else n // fan
            level.setdefault(up, []).append((n, *nodes[n]))
    return sorted(out)


@pytest.mark.parametrize(("leaf", "fan", "low"), [(4, 2, 0), (64, 16, 0), (3, 3, -40)])
def test_tree_and_changes(spark, leaf, fan, low):
    rnd = random.Random(leaf)
    old = {i: sha(str(rnd.random())) for i in rnd.sample(range(low, 300), 120)}
    new = dict(old)
    for i in rnd.sample(sorted(old), 9):
        new[i] = sha("new")
    for i in rnd.sample(sorted(old), 3):
        new.pop(i)
    new |= {i: sha("added") for i in range(297, 300)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, digest string").repartition(3)
    trees = {}
    for name, rows in (("old", old), ("new", new)):
        trees[name] = hashtree.tree(frame(rows), leaf, fan)
        assert sorted(map(tuple, trees[name].collect())) == by_plain_python(rows.items(), leaf, fan)
    want = sorted((i, "added" if i not in old else "deleted" if i not in new else "changed") for i in {*old, *new} if old.get(i) != new.get(i))
    assert sorted(map(tuple, hashtree.changes(frame(old), frame(new), leaf, fan).collect())) == want
    leaves = {r.node for r in hashtree.differing(trees["old"], trees["new"], fan).collect()}
    assert leaves == {i // leaf for i, _ in want}
    assert hashtree.changes(frame(old), frame(old), leaf, fan).collect() == []


def test_empty_tables_nulls_and_repeats(spark):
    none = spark.createDataFrame([], "id long, digest string")
    some = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "id long, digest string")
    assert hashtree.tree(none).collect() == []
    assert [(r.level, r.node, r.n) for r in hashtree.tree(some).collect()] == [(0, 0, 2)]
    assert sorted(map(tuple, hashtree.changes(none, some.dropDuplicates().filter("id = 1")).collect())) == [(1, "added")]
    a, b = (hashtree.digests(spark.createDataFrame([(1, x, y)], "doc_id long, p string, q string"), ["p", "q"]).first().digest for x, y in (("a", None), (None, "a")))
    assert a != b


def test_buckets_are_joined_where_they_lie(spark):
    run = uuid.uuid4().hex
    rows = spark.range(200).select("id", (F.col("id") % 20).alias("document_id"), F.when(F.col("id") % 20 < 5, "en").otherwise("fr").alias("index_name"), F.lit("v1").alias("index_version"))
    docs = spark.range(20).select("id", F.lit("t").alias("title"), F.lit("").alias("notice_id"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("posted_at"), F.when(F.col("id") < 5, "en").otherwise("fr").alias("index_name"), F.lit("v1").alias("index_version"))
    a, b = store.bucketed(rows, f"c_{run}", "document_id", 4), store.bucketed(docs, f"d_{run}", "id", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.documented_chunks(a, b, "en", "v1")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert all("index_name=en" in f for f in store.namespace(a, index_name="en").select("id").inputFiles()) or "PartitionFilters: [isnotnull(index_name" in store.namespace(a, index_name="en")._jdf.queryExecution().executedPlan().toString()
