"""op12 against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import phrases

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_plain_python(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(words[i : i + m] for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least}
        best = []
        for p, a in known.items():
            if len(p) == 1:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in inside):
                best.append((score, a, " ".join(p), left, right))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, left, right, n[lang], score) for k, (score, a, p, left, right) in enumerate(best[:top])]
    return sorted(out)


def made(spark, rows):
    extra = ("word", "words", "n", "id", "key", "i0", "size", "rank", "source")
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, lang string" + "".join(f", {c} string" for c in extra))


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(8)
    rows = [(1, None, None), (2, "", "en"), (3, " . \t ,", "en"), (None, "a a a a a a a a", "en"), (4, "Ärger mit é\x01 b é c", "de"), (4, "Ärger mit é\x01 b é c", "de")]
    for k in range(260):
        words = [rnd.choice(["the", "of", "New York", "new\tyork city", "é\x01 b", "é c", "a", "rare%d" % rnd.randrange(900), "end.", "pause,now", "x\ny", "X"]) for _ in range(rnd.randrange(1, 60))]
        rows.append((k, " ".join(words), ["en", "en", "fr", None, "und"][k % 5]))
    return rows + rows[30:50] + [(9, "New York city of the a " * 3000, "fr")]


@pytest.mark.parametrize(("least", "top", "slab", "per_range"), [(30, 2000, 8 << 20, 2_000_000), (5, 2000, 2000, 40), (2, 7, 500, 3)])
def test_phrases_are_those_of_all_counts(spark, talk, least, top, slab, per_range):
    got = phrases.collocations(made(spark, talk), least=least, top=top, slab=slab, per_range=per_range)
    want = by_plain_python(talk, least, top)
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_an_empty_table_gives_none(spark):
    assert phrases.collocations(made(spark, [])).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_packed_keys_sort_as_their_numbers(width):
    rnd = np.random.default_rng(width)
    columns = [rnd.integers(0, min(256**width, 1 << 40), 500).astype(np.uint64) % np.uint64(1 + 7 ** (k + 1)) for k in range(4)]
    keys = phrases.packed(columns, width)
    assert all((a == b).all() for a, b in zip(columns, phrases.unpacked(keys.slice(0), width), strict=True))
    assert all((a[100:] == b).all() for a, b in zip(columns, phrases.unpacked(keys.slice(100), width), strict=True))
    order = phrases.radix_order(columns, width)
    rows = list(zip(*[c.tolist() for c in columns], strict=True))
    assert [rows[k] for k in order] == sorted(rows)
    assert [k.as_py() for k in keys.take(pa.array(order))] == sorted(k.as_py() for k in keys)
    distinct, n = phrases.counted_runs(columns, np.arange(500), width)
    want = Counter()
    for k, r in enumerate(rows):
        want[r] += k
    assert list(zip(*[c.tolist() for c in distinct], strict=True)) == sorted(want) and n.tolist() == [want[r] for r in sorted(want)]
