"""The stages together, against the operators' brute force."""

import re
from collections import Counter

import corpus_pipeline
from lodestone.llm import decontam, piece_codec
from tests.llm.conftest import make
from tests.llm.test_operators import near_by_brute_force, shingles

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, now = docs.columns, docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()} if "text" in now.columns else held
        now = stage(spark, now, DATA)
        held = {r.doc_id: r for r in now.collect()}
        if name == "encoded":
            assert set(held) == set(before) and all(r.round_trip for r in held.values())
            c = piece_codec.codec(piece_codec.model_path())
            assert all(r.ids == [int(x) for x in memoryview(c.encode_batch([before[d]])[0]).cast("I")] for d, r in list(held.items())[:20])
            continue
        assert now.columns == columns and held.keys() <= before.keys()
        if name == "language":
            assert all(any(ch.isalpha() for ch in before[d]) for d in held) and len(held) > 0.98 * len(before)
        if name == "copies":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            first = {}
            for d in sorted(before):
                first.setdefault(norm(before[d]), d)
            assert set(held) == set(first.values())
        if name == "near_copies":
            want = near_by_brute_force([(d, t, None) for d, t in before.items()])
            assert set(held) == {want[shingles(t)][1] for t in before.values()}
        if name == "decontaminated":
            assert set(held) == {r[0] for r in decontam.reference(list(before.items()), bench) if not r[5]}


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    want = sorted(map(tuple, docs.drop("ids").collect()))
    got = corpus_pipeline.run(spark, DATA)
    assert "ids" not in got.columns and sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_odd_tables(spark, odd_rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns: each stage against plain rules."""
    rows = [(d, t, "en" if t and t.isascii() and any(c.isalpha() for c in t) else None) for d, t, _ in odd_rows] + [(900, "12 34", "en")]
    docs = make(spark, rows)
    base = next(t for d, t, _ in odd_rows if d == 3)
    spark.createDataFrame([(1, " ".join(base.split()[100:112])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = [(d, t) for d, t, _ in rows]
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, now
        docs = stage(spark, docs, str(tmp_path))
        if name == "encoded":
            got = docs.collect()
            assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in before) and all(r.round_trip for r in got)
            break
        assert docs.columns == columns
        now = [(r.doc_id, r.text) for r in docs.collect()]
        kept, all_ = Counter(map(repr, now)), Counter(map(repr, before))
        assert not kept - all_
        if name == "language":
            assert not any(t is None or not any(c.isalpha() for c in t) for _, t in now) and len(now) >= 20
        if name == "copies":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            least = {}
            for d, t in before:
                least[norm(t)] = min(least.get(norm(t), (True, None)), (d is None, d or 0))
            assert sorted((d is None, d or 0) for d, _ in now) == sorted(least.values())
        if name == "near_copies":
            want = near_by_brute_force([(d, t, None) for d, t in before])
            assert sorted(repr(d) for d, _ in now) == sorted({repr(want[shingles(t)][1]) for _, t in before})
        if name == "decontaminated":
            clean = [w[0] for w in decontam.reference(before, [(1, " ".join(base.split()[100:112]))]) if not w[5]]
            assert sorted(map(repr, clean)) == sorted(repr(d) for d, _ in now) and len(now) < len(before)


def test_empty_tables(spark, tmp_path):
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
