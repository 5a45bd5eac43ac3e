"""An index in versions: updates against rebuilds, publication, the lease."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.plans import versions


def frame(spark, rows):
    """(document_id, title, text) as documents."""
    kind = "document_id string, title string, path string, url string, posted_at string, content_type string, metadata map<string,string>, text string"
    return spark.createDataFrame([(i, t, "", "", None, "text", {"k": t or ""}, x) for i, t, x in rows], kind)


def state(index):
    """What a reader sees: chunks, vectors' ids, terms, totals."""
    ix = index.read()
    return (
        sorted(map(tuple, ix.chunks.select("id", "title", "text").collect())), sorted(r.id for r in ix.vectors.select("id").collect()), sorted(map(tuple, ix.bm25.terms.collect())),
        tuple(ix.bm25.stats.first()), sorted((r.id, r.dl, sorted(zip(r.terms, r.tfs))) for r in ix.bm25.texts.collect()))


def test_updates_give_what_a_rebuild_gives(spark, tmp_path):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", f"w{rnd.randrange(50)}"]) for _ in range(rnd.randrange(0, 400)))
    rows = {f"d{k}": ("title", text()) for k in range(12)} | {"none": (None, None), "empty": ("t", "")}
    index = versions.VersionedIndex(spark, str(tmp_path / "kept"))
    assert index.update(frame(spark, [(i, *x) for i, x in rows.items()])) == {"reason": "FIRST", "version": 1, "added": 14, "changed": 0, "deleted": 0, "same": 0}
    steps = []
    for n in range(2):
        gone, other = rnd.sample(sorted(rows), 2)
        del rows[gone]
        rows[other if other in rows else "d0"] = ("another", text())
        rows[f"new{n}"] = ("title", text())
        if n:
            rows[gone] = ("back", "it has come back with beta")
        steps.append(index.update(frame(spark, [(i, *x) for i, x in rows.items()])))
        fresh = versions.VersionedIndex(spark, str(tmp_path / f"built{n}"))
        fresh.update(frame(spark, [(i, *x) for i, x in rows.items()]))
        assert state(index) == state(fresh)
    assert [s["reason"] for s in steps] == ["CHANGED"] * 2 and [s["version"] for s in steps] == [2, 3]
    assert index.update(frame(spark, [(i, *x) for i, x in rows.items()]))["reason"] == "UP_TO_DATE" and index.current().number == 3
    q = spark.createDataFrame([(1, "alpha w7 w9"), (2, "beta")], "query_id long, question string")
    ranked = lambda ix: [tuple(r) for r in lexical.search(ix.read().bm25, q, 5).orderBy("query_id", "bm25_rank").collect()]
    assert ranked(index) == ranked(fresh)
    few = frame(spark, [("d0", *rows.get("d0", ("t", "x")))])
    assert index.update(few)["reason"] == "COMPACTED" and len(index.current().segments) == 1 and len(index.read().chunks.select("document_id").distinct().collect()) <= 1
    index.clean()
    assert index.update(few, force=True)["reason"] == "FORCED"


def test_an_update_that_breaks_off_is_not_seen(spark, tmp_path):
    index = versions.VersionedIndex(spark, str(tmp_path))
    index.update(frame(spark, [("a", "t", "one"), ("b", "t", "two")]))
    before = state(index)

    def breaks_off(step):
        raise RuntimeError("broken off")

    with pytest.raises(RuntimeError):
        index.update(frame(spark, [("a", "t", "other")]), broken=breaks_off)
    assert state(index) == before and index.current().number == 1 and index.files.read("lease.json") is None
    assert len(index.files.names("segments")) == 2
    index.clean()
    assert len(index.files.names("segments")) == 1 and state(index) == before
    assert index.update(frame(spark, [("a", "t", "other")]))["version"] == 2


def test_one_writer_at_a_time(spark, tmp_path):
    files = versions.Files(spark, str(tmp_path))
    with versions.Lease(files, 60):
        with pytest.raises(versions.Refused), versions.Lease(files, 60):
            pass
    with versions.Lease(files, 0.05) as first:
        time.sleep(0.1)
        assert not first.valid()
        with versions.Lease(files, 60) as second:
            assert second.valid() and not first.valid()
        assert files.read("lease.json") is None
    assert files.names("") == [] or all("lease" not in n for n in files.names(""))


def test_an_empty_corpus(spark, tmp_path):
    index = versions.VersionedIndex(spark, str(tmp_path))
    assert index.update(frame(spark, []))["reason"] == "FIRST"
    assert index.read().chunks.collect() == [] and index.read().bm25.stats.first()["avgdl"] == 0
    assert index.update(frame(spark, [("a", "t", "one")]))["added"] == 1
    assert index.digests(index.current()).select(F.count("*")).first()[0] == 1
