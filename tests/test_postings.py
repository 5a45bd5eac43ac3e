"""Posting lists in blocks, against scores of all texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings


def all_scores(texts, question, profile):
    words = {d: re.findall("[0-9a-z]+", (t or "").lower()) for d, t in texts}
    if profile == "online":
        words = {d: [x for x in w if len(x) > 1] for d, w in words.items()}
    average = sum(map(len, words.values())) / max(1, len(words)) or 1.0
    df = Counter(x for w in words.values() for x in set(w))
    asked = Counter(x for x in re.findall("[0-9a-z]+", question.lower()) if profile == "offline" or len(x) > 1)
    out = {}
    for d, w in words.items():
        tf = Counter(w)
        s = sum((n if profile == "offline" else 1) * math.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(w) / average)) for x, n in asked.items() if tf[x])
        if s > 0:
            out[d] = s
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    frequent, rare = ["the", "of", "and", "in"], [f"w{k}" for k in range(400)]
    rows = [("none", None), ("empty", ""), ("marks", "!? .")]
    for k in range(700):
        n = rnd.randrange(1, 60)
        rows.append((f"t{k:03}", " ".join(rnd.choice(frequent if rnd.random() < 0.5 else rare[: rnd.choice([4, 40, 400])]) for _ in range(n))))
    return rows + [(f"copy{k}", rows[9][1]) for k in range(6)] + [("long", "the of w1 " * 20_000)]


@pytest.mark.parametrize(("profile", "k", "block", "slab"), [("offline", 10, 8, 500), ("online", 3, 4, 10**6), ("offline", 10_000, 128, 2000)])
def test_the_best_are_those_of_all_scores(spark, texts, profile, k, block, slab):
    rnd = random.Random(k)
    asked = [(q, " ".join(rnd.choice(["the", "of", "w1", "w3", f"w{rnd.randrange(400)}", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(1, 12)))) for q in range(25)] + [(98, "unknown words"), (99, None)]
    docs = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    index = postings.build(docs, profile=profile, block=block, slab=slab)
    assert index.blocks.filter(F.size("posts") > block).isEmpty() and index.blocks.filter("n <> size(posts)").isEmpty()
    questions = spark.createDataFrame(asked, "query_id long, question string")
    got = {}
    for r in postings.search(index, questions, k).collect():
        got.setdefault(r.query_id, []).append((r.bm25_rank, r.id, r.bm25_score))
    for q, text in asked:
        best = sorted(all_scores(texts, text or "", profile).items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        own = sorted(got.get(q, []))
        assert [(i, d) for i, d, _ in own] == [(i + 1, d) for i, (d, _) in enumerate(best)]
        assert all(abs(s - b) < 1e-5 for (_, _, s), (_, b) in zip(own, best, strict=True))


def test_blocks_are_skipped(spark, texts):
    index = postings.build(spark.createDataFrame(texts, "chunk_id string, text string"), block=8, slab=500)
    heads = postings.candidates(index, spark.createDataFrame([(1, "the w7 of w123 w300"), (2, "and w9 w11")], "query_id long, question string"), 5)[1]
    read, whole = heads.filter("read").count(), heads.count()
    assert 0 < read < whole / 3


def test_an_empty_table_and_no_questions(spark):
    empty = postings.build(spark.createDataFrame([], "chunk_id string, text string"))
    some = postings.build(spark.createDataFrame([("a", "one two")], "chunk_id string, text string"))
    questions = spark.createDataFrame([(1, "one")], "query_id long, question string")
    assert postings.search(empty, questions).collect() == []
    assert postings.search(some, questions.limit(0)).collect() == []
    assert [r.id for r in postings.search(some, questions).collect()] == ["a"]
