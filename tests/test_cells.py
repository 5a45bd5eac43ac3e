"""The vector index and the search of all vectors, against plain products."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import cells, dense


def best(vectors, q, k, dim):
    out = []
    for i, v in vectors:
        s = 0.0
        if v is not None and q is not None and len(v) == len(q) == dim and np.linalg.norm(v) and np.linalg.norm(q):
            s = float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q))
        out.append((-round(s, 9), i))
    return [(i, r + 1) for r, (_, i) in enumerate(sorted(out)[:k])]


@pytest.fixture(scope="module")
def clustered():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 8)) * 5
    rows = [(f"v{k:04}", (centres[k % 12] + rnd.normal(size=8) * 0.3).tolist()) for k in range(900)]
    rows += [(f"same{k}", rows[0][1]) for k in range(40)] + [("none", None), ("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("empty", [])]
    random.Random(1).shuffle(rows)
    asked = [(k, rows[k][1]) for k in range(0, 60, 3)] + [(100, [0.0] * 8), (101, None), (102, [1.0]), (103, rnd.normal(size=8).tolist())]
    return rows, asked


@pytest.mark.parametrize(("k", "small"), [(5, False), (50, False), (2000, False), (7, True)])
def test_both_searches_give_the_nearest(spark, clustered, k, small, monkeypatch):
    if small:  # many products and many settlings
        monkeypatch.setattr(dense, "PAIRS", 40)
    rows, asked = clustered
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked[:5] + asked[-4:] if small else asked, "query_id long, embedding array<double>")
    index = cells.build(v, dim=8, cells=12)
    found, report = cells.search(index, q, k)
    for got in (found, dense.search(v, q, k, dim=8)):
        by = {}
        for r in got.collect():
            by.setdefault(r.query_id, []).append((r.id, r.dense_rank))
        for i, x in asked:
            if i in by:
                assert sorted(by[i], key=lambda t: t[1]) == best(rows, x, k, 8), i
        assert len(by) == (9 if small else len(asked))
    if k == 5:
        with_direction = report[0]["cells_read"] - 3 * 12  # three queries have none and read all
        assert with_direction < 0.4 * (len(asked) - 3) * 12


def test_an_empty_table_and_no_queries(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = some.withColumnRenamed("id", "query_id")
    assert cells.search(cells.build(none), q)[0].collect() == []
    assert cells.search(cells.build(some), q.limit(0))[0].collect() == []
    assert [(r.id, r.dense_rank) for r in cells.search(cells.build(some), q)[0].collect()] == [(1, 1)]


def test_what_is_kept_is_bounded():
    held, rnd = dense.Nearest(3, 4), np.random.default_rng(0)
    scores = np.round(rnd.random((3, 5000)), 2)  # many ties
    ids = [f"i{k:05}" for k in rnd.permutation(5000)]
    for at in range(0, 5000, 50):
        held.add(scores[:, at : at + 50], pa.array(ids[at : at + 50]))
    t = held.best().to_pydict()
    for q in range(3):
        want = sorted(zip(-scores[q], ids, strict=True))[:4]
        assert [(x, i) for y, x, i in zip(t["q"], t["r"], t["id"], strict=True) if y == q] == [(-s, i) for s, i in want]
    assert held.size == 12
