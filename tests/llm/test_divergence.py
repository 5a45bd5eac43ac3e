"""op11 against plain Python."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lodestone.llm import divergence, tokens
from tests.llm.conftest import prose

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_plain_python(rows, least, top=divergence.TOP):
    n, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        n[lang, source].update(words)
        df[lang].update(set(words))
        sources[lang].add(source)
    out = []
    for lang, known in sources.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in known}
        of_lang = {t: sum(n[lang, s][t] for s in known) for t in kept}
        p = lambda c, whole: 1 + 10**9 * (c + 5) // (whole + 5 * len(kept))  # noqa: B023, E731
        for s in known:
            far = {o: sum(abs(p(n[lang, s][t], total[s]) - p(n[lang, o][t], total[o])) for t in kept) for o in known if o != s}
            own = {t: p(n[lang, s][t], total[s]) - p(of_lang[t], sum(of_lang.values())) for t in kept if n[lang, s][t]}
            for part, values, most in (("pair", far, None), ("term", {t: v for t, v in own.items() if v > 0}, top)):
                best = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(best[:most])]
    return sorted(out)


def made(spark, rows):
    extra = ("s", "t", "term", "n", "df", "row", "sid", "part", "value")
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, lang string, source string" + "".join(f", {c} string" for c in extra))


@pytest.fixture(scope="module")
def sourced():
    rnd = random.Random(4)
    rows = [(1, None, None, None), (2, "", "en", "empty"), (3, "12 34 !", "en", "no words"), (3, "Ärger ärger ÄRGER Zoo", "de", "a"), (None, "One one ONE", "fr", "only")]
    for k in range(300):
        lang = ["en", "en", "de", None][k % 4]
        text = " ".join(rnd.choice(["Alpha", "beta", "gamma,delta", "été", "x1y", "漢字", "w" + chr(97 + rnd.randrange(26))]) for _ in range(rnd.randrange(1, 40)))
        rows.append((k, text, lang, "hot" if k % 3 == 0 else f"s{rnd.randrange(9)}"))
    return rows + rows[40:60] + [(9, "longword " * 30_000, "en", "s1")]


@pytest.mark.parametrize(("least", "block", "terms"), [(30, 64, 4096), (3, 2, 5), (1, 3, 1), (10_000, 64, 4096)])
def test_distances_are_those_of_all_terms(spark, sourced, least, block, terms):
    got = divergence.audit(made(spark, sourced), least=least, block=block, terms=terms)
    assert sorted(map(tuple, got.collect())) == by_plain_python(sourced, least)


def test_counts_past_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**12, 5 * 10**12, 10**6), (0, 0, 3)], "n long, total long, v long")
    assert [r[0] for r in df.select(divergence.share(df.n, df.total, df.v)).collect()] == [1 + 10**9 * (4 * 10**12 + 5) // (5 * 10**12 + 5 * 10**6), 1 + 10**9 * 5 // 15]


def test_an_empty_table_gives_none(spark):
    assert divergence.audit(made(spark, [])).collect() == []


def test_slabs_hold_every_row_once():
    rnd = random.Random(1)
    texts = [None, ""] + [prose(rnd, rnd.randrange(30)) for _ in range(200)] + ["x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "text"])
    parts = list(tokens.slabs([batch, batch.slice(0, 0)], 1, 300))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 300 for p in parts)


class Captured:
    """Stands for a table, and keeps what its batches are sent to."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def same(self, *_):
        return self

    select = groupBy = agg = same


@pytest.mark.parametrize("rows", [3000, 1])
def test_counting_holds_little_at_once(spark, rows):
    rnd = random.Random(7)
    known = ["w" + "".join(rnd.choices(LOWER, k=4)) for _ in range(20_000)]
    texts = [" ".join(rnd.choices(known, k=2_000_000 // rows)) for _ in range(rows)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * rows), pa.array([f"s{k % 20}" for k in range(rows)]), pa.array(texts)], ["lang", "source", "text"])
    docs = Captured()
    divergence.term_counts(docs)
    tracemalloc.start()
    try:
        n = sum(sum(b.column(3).to_pylist()) for b in docs.run(iter([batch])))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == rows * (2_000_000 // rows) and held < 100_000_000


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1000])
def test_a_text_in_stretches_is_counted_once(size):
    rnd = random.Random(8)
    text = "".join(rnd.choice(["Alpha", " ", "beta1", "ÉTÉ", "漢字", ", ", "x" * 60, " b ", "\n"]) for _ in range(400))
    for lang, content in (("en", text), (None, text), ("en", "x" * 99), ("en", "1" * 99), ("en", "1" * 50 + "ab")):
        part = pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array(["s"]), pa.array([content])], ["lang", "source", "text"])
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", content.translate(str.maketrans(UPPER, LOWER))))
        assert sorted(map(tuple, (r.values() for r in divergence.counted(part, size).to_pylist()))) == sorted((lang or "", "s", w, n, 1) for w, n in words.items())
