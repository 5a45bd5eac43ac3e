"""op13 against plain Python."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from tests.llm.conftest import make, prose


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def bucket(v):
    e = max(v.bit_length() - 6, 0)
    return e * 32 + (v >> e)


def bounds(b):
    e = max(b // 32 - 1, 0)
    return (b - 32 * e) << e, ((b - 32 * e + 1) << e) - 1


def fences(values):
    """[(low, high)] of lists of measures, by sorting all values."""
    out = []
    for k, (_, slack, both) in enumerate(quality.MEASURES):
        v = sorted(x[k] for x in values)
        at = lambda tenths: bounds(bucket(v[math.ceil(len(v) * tenths / 10) - 1]))  # noqa: B023, E731
        (d1, _), (mid_low, mid_high), (_, d9) = at(1), at(5), at(9)
        out.append((d1 - max((mid_high - d1) * quality.SPREAD, slack) if both else None, d9 + max((d9 - mid_low) * quality.SPREAD, slack)))
    return out


def by_plain_python(rows, least):
    """rows (id, text, lang, source) to sorted results."""
    told, groups = [], defaultdict(list)
    for d, text, lang, source in rows:
        n, chars, symbols, lines, dup, rep = measures(text)
        failed = n < 10 or 100 * rep > 20 * n
        own = None if failed else (chars * 100 // n, symbols * 1000 // n, dup * 1000 // lines, rep * 1000 // n)
        told.append((d, n, chars, symbols, dup, rep, failed, own, lang, source))
        if own:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(own)
    known = {key: fences(v) for key, v in groups.items() if len(v) >= least}
    out = []
    for *head, own, lang, source in told:
        f = next((known[k] for k in ((lang, source), (lang,), ()) if k in known), None)
        bad = [quality.MEASURES[k][0] for k in range(4) if own and f and (own[k] > f[k][1] or (f[k][0] is not None and own[k] < f[k][0]))]
        out.append((*head, not head[-1] and not bad, ",".join(bad)))
    return sorted(out, key=repr)


@pytest.fixture
def sourced(spark, odd_rows):
    import random

    rnd = random.Random(11)
    rows = [(d, t, lang, "odd" if d and d % 2 else None) for d, t, lang in odd_rows]
    for k in range(160):
        t = prose(rnd, rnd.randrange(5, 60), 90)
        t += [" ### | $$ %% " * rnd.randrange(9), "\nsame line\nsame line" * rnd.randrange(4), " a b c d e f a b c d e", " " + "longword" * 20, ""][k % 5]
        rows.append((1000 + k, t, ["en", "fr", "", None][k % 4], ["a", "b", "b", "b", "c"][k % 5]))
    return rows


@pytest.mark.parametrize("least", [1, 20, 90, 10_000])
def test_quality_is_that_of_sorted_values(spark, sourced, least):
    df = make(spark, [(d, t, lang) for d, t, lang, _ in sourced]).drop("source")
    sources = spark.createDataFrame([(k, s) for k, (*_, s) in enumerate(sourced)], "k long, source string").collect()
    df = spark.createDataFrame([(*r, s.source) for r, s in zip(df.collect(), sources, strict=True)], df.schema.add("source", "string"))
    got = sorted(map(tuple, quality.quality(df, least=least).collect()), key=repr)
    want = by_plain_python(sourced, least)
    assert got == want
    assert ({r[-1] for r in got} > {""}) == (least in (20, 90))


def test_sketches_merge_to_that_of_all(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") * F.col("id")).alias("v"))
    s = rows.select("g", F.lit(0).alias("measure"), quality.bucket(F.col("v")).alias("bucket")).groupBy("g", "measure", "bucket").agg(F.count("*").alias("n"))
    got = {r.bucket: r.n for r in quality.merged(s, []).collect()}
    want = defaultdict(int)
    for k in range(3000):
        want[bucket(k * k)] += 1
    assert got == dict(want)
    limits = spark.range(1800).select("id", *quality.bounds(F.col("id"))).collect()
    assert all((r[1], r[2]) == bounds(r.id) and bucket(r[1]) == bucket(r[2]) == r.id for r in limits)


def test_accepted_rows_and_empty_tables(spark, odd_rows):
    df = make(spark, odd_rows)
    kept = quality.accepted(df)
    assert kept.columns == df.columns
    want = [r for r in quality.quality(df).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in want)
    assert quality.quality(make(spark, [])).collect() == [] == quality.accepted(make(spark, [])).collect()
