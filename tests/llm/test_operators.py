"""Each operator against brute force, on tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import anchors, decontam, exact, jaccard, langid, pii, piece_codec, shards, suffixes, urls
from tests.llm.conftest import make, prose

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
order = lambda d: (d is None, d)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("op", [
    lambda d: exact.exact_dedup(d), lambda d: jaccard.near_duplicates(d), lambda d: anchors.substring_dedup(d), lambda d: suffixes.suffix_dedup(d),
    lambda d: langid.language_id(d), lambda d: shards.shard(d), lambda d: pii.personal_data(d), lambda d: piece_codec.encode(d), lambda d: exact.first_of_each(d),
    lambda d: jaccard.first_of_each(d), lambda d: langid.accepted(d)])
def test_an_empty_table_gives_none(spark, op):
    assert op(make(spark, [])).collect() == []


# -- op1


def test_encoding_is_the_librarys(spark, odd_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    rnd = random.Random(1)
    texts = [t for _, t, _ in odd_rows] + ["".join(rnd.choice("abcdefgh  \n\té漢😀.,01▁") for _ in range(rnd.randrange(60))) for _ in range(400)] + ["<s> </s>", "  a   b "]
    df = make(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in piece_codec.encode(df).collect()}
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(df).select("doc_id", "ids")).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        assert list(got[k].ids) == sp.encode(t), t
        assert got[k].n_tokens == len(got[k].ids)
        assert got[k].round_trip == ("▁" not in t)
        assert back[k] == t.replace("▁", " ")


def test_a_block_smaller_than_a_unit(monkeypatch):
    monkeypatch.setattr(piece_codec, "BLOCK", 16)
    c, whole = piece_codec.Codec(piece_codec.model_path()), None
    whole = c.encode_batch(["the quick brown fox " + "abcdefgh" * 20, "the"])
    monkeypatch.undo()
    assert whole == piece_codec.Codec(piece_codec.model_path()).encode_batch(["the quick brown fox " + "abcdefgh" * 20, "the"])


def test_pairs_of_pieces_by_merging_their_joint_text():
    c, rnd = piece_codec.Codec(piece_codec.model_path()), random.Random(2)

    def merged(text):
        parts = list(text)
        while True:
            scores = [c.rank.get(a + b, (float("-inf"),))[0] for a, b in zip(parts, parts[1:], strict=False)]
            if not scores or max(scores) == float("-inf"):
                return parts
            at = scores.index(max(scores))
            parts[at : at + 2] = ["".join(parts[at : at + 2])]

    n = len(c.texts)
    pairs = [(rnd.randrange(-1, n), rnd.randrange(n)) for _ in range(3000)] + [(n + ord("\u0378"), rnd.randrange(n)) for _ in range(20)]
    for k in rnd.sample(range(n), 3000):  # pairs that merge somewhere
        p = c.texts[k]
        pairs += [(c.index[p[:i]], c.index[q]) for i in range(1, len(p)) for q in (p[i:], p[i:] + p[i:], p[i:] + "s") if p[:i] in c.index and q in c.index]
    names = [[c.texts[k] if k < n else chr(k - n) for k in pair if k >= 0] for pair in pairs]
    want = [merged("".join(x)) == x for x in names]
    left, right = np.array(pairs).T
    assert c.told(left, right).tolist() == want
    assert 0 < sum(want) < len(want)
    assert c.fits(left, right).tolist() == want == c.fits(left, right).tolist()


def test_a_memo_that_is_dropped_and_texts_taken_one_by_one(monkeypatch):
    rnd = random.Random(3)
    texts = [None, "", " ", "\n", "\n \n", "a\0b \0"] + ["".join(rnd.choice("abc  \n\té漢😀▁") for _ in range(rnd.randrange(90))) for _ in range(200)]
    want = piece_codec.Codec(piece_codec.model_path()).encode_batch(texts)
    monkeypatch.setattr(piece_codec, "MEMO", 20)
    monkeypatch.setattr(piece_codec, "MEMO_CHARS", 4)
    monkeypatch.setattr(piece_codec, "GROUP", 30)
    c = piece_codec.Codec(piece_codec.model_path())
    assert c.encode_batch(texts) == want
    assert [c.encode_batch([t])[0] for t in texts] == want
    assert c.decode_batch(want) == [(t or "").replace("▁", " ") for t in texts]


# -- op2


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_by_brute_force(rows):
    """{set: (links, smallest id of its class, smallest id of its set)}"""
    by = {}
    for d, t, _ in rows:
        by.setdefault(shingles(t), []).append(d)
    nodes = list(by)
    links = {s: [u for u in nodes if u is not s and s and u and len(s & u) >= 0.8 * len(s | u)] for s in nodes}
    out = {}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out[s] = (len(links[s]), min((d for u in seen for d in by[u]), key=order), min(by[s], key=order))
    return out


def near_table(seed=3):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(rnd, 150).split()
        for _ in range(rnd.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en"))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_near_copies(spark, odd_rows, block):
    rows = near_table() + [(None if d is None else d + 1000, t, x) for d, t, x in odd_rows]
    want = near_by_brute_force(rows)
    got = jaccard.near_duplicates(make(spark, rows), block=block).collect()
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(want[shingles(t)])
    assert len(got) == len(rows)
    assert sorted((repr(r.doc_id), r.n_links, repr(r.class_id), repr(r.set_id)) for r in got) == sorted((repr(d), n, repr(c), repr(s)) for d, ws in texts.items() for n, c, s in ws)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.class_id for r in kept)
    assert len(kept) == len({w[1:2] + (bool(s),) for s, w in want.items()})


def test_pairs_in_common_runs_and_rare_ones():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    i, j = jaccard.similar(sets, None, 0.5)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    i, j = jaccard.similar(sets[:15], sets[15:], 0.5)
    assert {(a, b + 15) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if a < 15 <= b}


def test_one_near_copy_stays(spark, odd_rows):
    rows = near_table(9) + [(None if d is None else d + 1000, t, x) for d, t, x in odd_rows]
    kept = jaccard.first_of_each(make(spark, rows))
    assert len(kept.columns) == len(make(spark, []).columns)
    want = near_by_brute_force(rows)
    classes = {repr(want[shingles(t)][1]) + str(bool(shingles(t))) for _, t, _ in rows}
    got = kept.collect()
    assert {repr(want[shingles(r.text)][1]) + str(bool(shingles(r.text))) for r in got} == classes
    assert len(got) == len(classes)


def test_the_floor_is_as_deep_as_recall_allows():
    d = jaccard.prefix_length()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def test_prefixes_are_shortened_until_recall_is_reached():
    """Pairs that are all but equal need no short prefixes; pairs at the threshold do."""
    near, far = np.zeros(jaccard.CLASSES), np.zeros(jaccard.CLASSES)
    near[-1], far[0] = 1000, 1000
    assert jaccard.reached_recall(near, jaccard.DEPTH, 0.8) > jaccard.RECALL > jaccard.reached_recall(far, jaccard.DEPTH, 0.8)
    assert jaccard.reached_recall(far, jaccard.prefix_length(), 0.8) >= jaccard.RECALL
    assert jaccard.reached_recall(0 * near, jaccard.DEPTH, 0.8) == 0


def signatures(rnd, n, share, size=200, core=None):
    """Signatures and sets of which each has a share of a common core."""
    core = rnd.integers(0, 1 << 63, int(size * share), dtype=np.uint64) if core is None else core
    made = [np.unique(np.concatenate([core, rnd.integers(0, 1 << 63, size - len(core), dtype=np.uint64)])) for _ in range(n)]
    return made, np.stack([jaccard.signature(s) for s in made])


@pytest.mark.parametrize("node", [128, 4])
def test_a_trie_ties_all_that_is_similar(monkeypatch, node):
    """With nodes of any size, what is similar and shares a prefix hangs together; what shares a passage alone does not."""
    monkeypatch.setattr(jaccard, "NODE", node)
    rnd = np.random.default_rng(5)
    near, a = signatures(rnd, 30, 0.95)
    far, b = signatures(rnd, 60, 0.55)  # similar by 0.38: they meet, but by a common passage
    low = np.concatenate([a, b])
    marks = np.frombuffer(b"".join(jaccard.sketch(x).tobytes() for x in low), np.uint64).reshape(len(low), -1)
    tied, met = set(), 0
    for t in range(jaccard.TREES):
        label = low[:, t * 8 : t * 8 + 8].astype(np.int64)
        order = np.lexsort(label.T[::-1])
        new = np.concatenate([[True], (label[order][1:, :6] != label[order][:-1, :6]).any(1)])
        met += len(new) - new.sum()
        i, j, _ = jaccard.matches(label[order], marks[order], new, 6, 0.8 - jaccard.SLACK)
        tied |= {(min(x, y), max(x, y)) for x, y in zip(order[i].tolist(), order[j].tolist(), strict=True)}
    parts = jaccard._reached(90, np.array([x for x, _ in tied]), np.array([y for _, y in tied]))
    assert len(set(parts[:30].tolist())) == 1 and met > len(tied) / 30
    assert len(set(parts[30:].tolist())) > 55
    sim = [len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x in near[:8] for y in near + far[:20]]
    est = [float(jaccard.likeness(marks[k], marks[m if m < 30 else m])) for k in range(8) for m in range(50)]
    assert max(abs(s - e) for s, e in zip(sim, est, strict=True)) < jaccard.SLACK


def test_chained_passages(spark):
    """Texts that share half of their words with the next group's, in a chain."""
    rnd = random.Random(12)
    links = [prose(rnd, 60, 10**6) for _ in range(61)]
    rows = [(k, f"{links[k // 5]} {links[k // 5 + 1]} {prose(rnd, 8, 10**6)}", "en") for k in range(300)]
    want = near_by_brute_force(rows)
    got = jaccard.near_duplicates(make(spark, rows)).collect()
    assert {(r.doc_id, r.n_links, r.class_id) for r in got} == {(d, *want[shingles(t)][:2]) for d, t, _ in rows}


# -- op3


def test_base_spans_are_the_patterns():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "b@c", "@", ".", "com", " ", "+", "1", "22", "255.", "256.", "4111 1111 1111 1111", "-", "(", ")", "é", "+1 (743) 555-3824 "]) for _ in range(rnd.randrange(40))) for _ in range(800)]
    for t in texts:
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
                want.append((2, m.start(), m.end()))
        want += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(t) == want, t


def test_long_tokens_take_time_in_proportion(spark):
    """A million letters, digits, at signs and so on, each within seconds on any machine; the quadratic way takes hours."""
    import time

    n = 1_000_000
    field = pii.fit([])
    texts = ["dot " + "a" * n, "1" * n, "x@" + "a" * n, "@" * n, "a@" * (n // 2), "1." * (n // 2), "+1" + " " * n, "a at " * (n // 5), "dot " + "a at b " * (n // 7), "(at)" * (n // 4), "5 " + "b" * n + " 7", " " * n + "at dot"]
    for t in texts:
        began = time.perf_counter()
        pii.all_spans(t, field)
        assert time.perf_counter() - began < 20, t[:20]
    long = "x " * 200_000 + "write a.b@c.example now or call (743) 555-3824 at once " + "y" * 500_000
    df = make(spark, [(1, long, "en"), (2, None, "en"), (3, "x", None)])
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    at = long.index("a.b@")
    assert f"email:{at}:{at + 13}" in got[1].spans and got[1].n_email == 1 and got[2].spans == ""


def test_windows_hold_what_is_near():
    t = "one two three four 5 six seven eight nine ten and bob (at) host (dot) com end of it a[at]b z"
    runs = [[t[a:b] for a, b in w] for w in pii.windows(t)]
    assert runs[0] == ["three", "four", "5", "six", "seven"][-len(runs[0]):] or runs[0][:5] == ["three", "four", "5", "six", "seven"]
    assert {"bob", "(at)", "host", "(dot)", "com", "a[at]b"} <= {x for w in runs for x in w}


def test_the_field_adds_what_patterns_miss(spark):
    rnd = random.Random(4)
    known = [f"{prose(rnd, 5)} {x} {prose(rnd, 5)}" for k in range(30) for x in (f"bob{k}@mail{k}.example.com", f"10.0.{k}.7", "4111 1111 1111 1111", f"+1 (743) 555-38{k:02}")]
    known += [f"{prose(rnd, 4)} version {k}.2 of 2020-01-{k:02} token {rnd.getrandbits(128):032x} {prose(rnd, 3)}" for k in range(1, 29)]
    extra = {1000: "call (743) 555-3824 now", 1001: "write bob.smith at example dot com please", 1002: "plain words 12345 in 2020-01-02", 1003: None, 1004: "", 1005: "é😀 a@b.co"}
    df = make(spark, [(k, t, None) for k, t in enumerate(known)] + [(k, t, None) for k, t in extra.items()])
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for k, t in [*enumerate(known), *extra.items()]:
        base = pii.base_spans(t or "")
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(b[0] == x for b in base) for x in range(4))
        assert got[k].base_sha256 == sha(pii.written(base))
        assert set(filter(None, pii.written(base).split(","))) <= set(got[k].spans.split(","))
    assert got[1000].spans == "phone:5:19"
    assert got[1001].spans.startswith("email:6:")
    assert got[1002].spans == got[1003].spans == got[1004].spans == ""
    assert got[1005].spans == "email:3:9"


def test_the_best_sequence_is_the_best_of_all():
    rnd = np.random.default_rng(3)
    f = pii.Field()
    f.w, f.t = rnd.normal(size=f.w.shape), rnd.normal(size=f.t.shape)
    w = pii.Window("a1 b2 c3 d4", [(0, 2), (3, 5), (6, 8), (9, 11)])
    sc = f.scores(w)

    def all_from(i, last):
        if i == 4:
            yield 0.0, ()
            return
        for s, rest in all_from(i + 1, 4):
            yield f.t[last, 4] + s, rest
        for k, seg in enumerate(w.segments):
            if seg[0] == i:
                for y in range(4):
                    for s, rest in all_from(seg[1], y):
                        yield f.t[last, y] + sc[k, y] + s, ((y, seg[2], seg[3]), *rest)

    paths = list(all_from(0, 4))
    assert tuple(f.best(w)) == max(paths)[1]
    gw, gt = np.zeros_like(f.w), np.zeros_like(f.t)  # the gradient of log p(gold), against a difference quotient
    gold = {(w.segments[0][0], w.segments[0][1]): 2}

    def likelihood():
        sc[:] = f.scores(w)
        ps = list(all_from(0, 4))
        mine = [s for s, p in ps if p == ((2, w.segments[0][2], w.segments[0][3]),)]
        return mine[0] - np.logaddexp.reduce([s for s, _ in ps])

    f.gradient(w, gold, gw, gt)
    for at in ((2, 0), (1, 0), (0, 15)):
        before = likelihood()
        f.w[at] += 1e-5
        assert abs((likelihood() - before) / 1e-5 - gw[at]) < 1e-3
        f.w[at] -= 1e-5


# -- op4


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_copies(spark, odd_rows, block):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, _ in odd_rows:
        groups.setdefault(norm(t), []).append(d)
    rows = [r for r in odd_rows if block > 7 or len(r[1] or "") < 10_000]
    got = exact.exact_dedup(make(spark, rows), block=block).collect()
    want = [(d, min(groups[norm(t)], key=order), len(groups[norm(t)]), sha(norm(t))) for d, t, _ in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=repr) == sorted({(min(groups[norm(t)], key=order), sha(norm(t))) for _, t, _ in rows}, key=repr)
    stay = exact.first_of_each(make(spark, rows), block=block).collect()
    assert sorted(((r.doc_id, sha(norm(r.text))) for r in stay), key=repr) == sorted(kept, key=repr)


def test_two_blocks_never_share_a_name(spark, monkeypatch):
    """Where a key stands for two blocks, another seed is taken."""
    seen = []
    whole = exact._name_blocks
    monkeypatch.setattr(exact, "_name_blocks", lambda b, seed: seen.append(seed) or (None if len(seen) == 1 else whole(b, seed)))
    assert exact.exact_dedup(make(spark, [(1, "a", None), (2, "a", None)])).count() == 2
    assert seen == [1, 2]


# -- op5, op6


def removed(items, size, join):
    """items: [(doc_id, sequence)]; the sequences without what windows of earlier documents cover, and the removed places."""
    first = {}
    for d, s in items:
        for i in range(len(s) - size + 1):
            w = s[i : i + size]
            first[w] = min(first.get(w, d), d, key=order)
    out = []
    for d, s in items:
        gone = set()
        for i in range(len(s) - size + 1):
            if order(first[s[i : i + size]]) < order(d):
                gone.update(range(i, i + size))
        out.append((d, gone, join(s, gone)))
    return out


def test_repeated_words_go(spark, odd_rows):
    items = [(d, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in odd_rows]
    want = [(d, len(s), len(gone), sha(kept), kept) for (d, s), (_, gone, kept) in zip(items, removed(items, 13, lambda s, g: " ".join(x for i, x in enumerate(s) if i not in g)), strict=True)]
    assert rows_of(anchors.substring_dedup(make(spark, odd_rows))) == sorted(want, key=repr)


def test_repeated_bytes_go(spark, odd_rows, monkeypatch):
    items = [(d, (t or "").encode()) for d, t, _ in odd_rows]
    found = removed(items, 50, lambda s, g: bytes(x for i, x in enumerate(s) if i not in g))
    want = [(d, len(s), len(g), sum(1 for i in g if i - 1 not in g), sha(kept)) for (d, s), (_, g, kept) in zip(items, found, strict=True)]
    assert rows_of(suffixes.suffix_dedup(make(spark, odd_rows), texts=False)) == sorted(want, key=repr)


def test_buckets_that_are_dealt_twice(spark, odd_rows, monkeypatch):
    from lodestone.llm import repeats

    rows = [r for r in odd_rows if len(r[1] or "") < 10_000]
    whole = rows_of(anchors.substring_dedup(make(spark, rows), texts=False)), rows_of(suffixes.suffix_dedup(make(spark, rows), texts=False))
    monkeypatch.setattr(repeats, "FAN", 3)
    assert (rows_of(anchors.substring_dedup(make(spark, rows), texts=False)), rows_of(suffixes.suffix_dedup(make(spark, rows), texts=False))) == whole


def test_parts_of_long_texts(monkeypatch):
    rnd = random.Random(6)
    raw = np.frombuffer(bytes(rnd.choice(b"ab ") for _ in range(5000)), np.uint8)
    whole = suffixes.stretches(raw, np.array([0, 5000]))
    monkeypatch.setattr(suffixes, "PART", 300)
    cut = suffixes.stretches(raw, np.array([0, 5000]))
    cover = lambda s: {i: (int(a), int(k)) for s0, s1, a, k in zip(*s[1:5], strict=True) for i in range(s0, s1 + 1)}
    assert cover(whole) == cover(cut)
    assert sorted(cover(whole)) == list(range(5000 - 49))


def test_suffixes_are_sorted():
    rnd = random.Random(7)
    b = bytes(rnd.choice(b"ab") for _ in range(400)) * 2 + bytes(rnd.choice(b"ab") for _ in range(200))
    text = suffixes.Text(np.frombuffer(b, np.uint8))
    suffix = np.arange(950)
    group = np.sort(np.array([rnd.randrange(6) for _ in suffix]))
    order, same = suffixes.suffix_sort(text, suffix, group)
    window = lambda i: b[i : i + 50]
    assert [window(i) for i in suffix[order]] == [x for g in range(6) for x in sorted({window(i) for i in suffix[group == g]})]
    assert all(window(x) == window(y) and group[x] == group[y] for x, y in enumerate(same))
    assert (suffixes.sorted_classes(text, suffix, group) == same).all()
    i, j = np.array([3, 10]), np.array([600, 10])
    assert text.common(i, j)[1] == 50 and text.common(i, j)[0] == next(k for k in range(51) if k == 50 or b[3 + k] != b[600 + k])


def test_hashes_that_mislead_change_nothing(spark, odd_rows, monkeypatch):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000]
    whole = rows_of(suffixes.suffix_dedup(make(spark, rows), texts=False))
    rnd = random.Random(7)
    b = bytes(rnd.choice(b"ab") for _ in range(300)) * 3
    text = suffixes.Text(np.frombuffer(b, np.uint8))
    suffix, group = np.arange(850), np.zeros(850, np.int64)
    monkeypatch.setattr(text, "common", lambda i, j: np.full(len(i), 0))  # all hashes differ
    same = suffixes.sorted_classes(text, suffix, group)
    assert len(set(same.tolist())) == len({b[i : i + 50] for i in range(850)}) and all(b[x : x + 50] == b[y : y + 50] for x, y in enumerate(same))
    monkeypatch.setattr(suffixes, "HOT", 3)  # windows dealt by themselves
    assert rows_of(suffixes.suffix_dedup(make(spark, rows), texts=False)) == whole


def test_no_hash_of_words_depends_on_where_they_stand():
    from lodestone.llm import hashing

    texts = pa.array(["alpha beta\x0bgamma", None, "", "beta", " delta alpha", "gamma", "漢 é漢"])
    h, start, stop = hashing.words(*hashing.buffers(texts))
    raw = hashing.buffers(texts)[0].tobytes()
    assert [raw[a:b].decode() for a, b in zip(start, stop, strict=True)] == ["alpha", "beta", "gamma", "beta", "delta", "alpha", "gamma", "漢", "é漢"]
    assert h.tobytes() == b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start, stop, strict=True))
    r = hashing.runs(h[:, 0], 2)
    assert r[0] != r[4] and hashing.runs(h[[1, 0, 0, 1]][:, 0], 2)[0] != hashing.runs(h[[1, 0, 0, 1]][:, 0], 2)[2]


def test_words_made_to_collide_do_not(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64, at any base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    df = make(spark, [(1, f"{rest} {one}", "en"), (2, f"{rest} {other}", "en"), (3, f"{rest} {one}", "en")])
    assert {r.doc_id: r.n_removed for r in anchors.substring_dedup(df, texts=False).collect()} == {1: 0, 2: 0, 3: 13}


def test_a_word_of_megabytes_between_repeats(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    df = make(spark, [(1, passage, "en"), (2, passage + " " + "x" * (5 << 20), "en"), (3, "y " + passage, "en")], extra=False)
    for part in (df.coalesce(1), df.repartition(3)):
        assert {r.doc_id: r.n_removed for r in anchors.substring_dedup(part, texts=False).collect()} == {1: 0, 2: 40, 3: 40}


def test_words_before_and_after_a_long_one(spark):
    """Ordinary words of the slab that holds a long word still meet those of other slabs."""
    passage = " ".join(f"w{k}" for k in range(40))
    long = "漢" * (1 << 20)
    rows = [(1, passage, "en"), (2, passage + " " + long + " end", "en"), (3, passage + " x", "en")]
    whole = make(spark, rows, extra=False)
    for df in (whole.coalesce(1), whole.repartition(3, "doc_id")):
        assert {r.doc_id: r.n_removed for r in anchors.substring_dedup(df, texts=False).collect()} == {1: 0, 2: 40, 3: 40}
        assert {r.doc_id: (r.n_links, r.class_id) for r in jaccard.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_a_set_that_changes_between_passes_is_an_error(spark, monkeypatch):
    a = prose(random.Random(2), 60)
    whole = jaccard.with_sets
    monkeypatch.setattr(jaccard, "with_sets", lambda docs, wanted: whole(docs.withColumn("text", F.concat("text", F.lit(" more"))), wanted))
    with pytest.raises(RuntimeError, match="2 of 2 sets"):
        jaccard.near_duplicates(make(spark, [(1, a, "en"), (2, a + " tail", "en")])).collect()


# -- op7


def test_url_verdicts(spark):
    page = lambda *links: "".join(f'<a href="{u}">x</a>' for u in links)
    rows = [
        (1, "http://A.Example.ORG/en/12?q#f", page("http://good.net/x")), (2, "https://example.org/es/x", page("http://bad.net/")), (3, "http://notexample.org/es/", None),
        (4, "http://good.net/", page("http://friend.net")), (5, "http://friend.net", ""), (6, "http://x.com/fr/a", page("//rel", "/rel", "http://good.net")),
        (7, "http://y.com/de/a", ""), (8, "http://evil.net/p", page("http://y.com/de/a")), (9, None, page("http://good.net")), (10, "no scheme", None), (10, "no scheme", None),
        (11, "http://example.org?x=/es/", ""), (13, "x" * 100_000, None), (14, "http://" + "y" * 100_000 + ".org/" + "z" * 9, "<a href='http://" + "q" * 100_000 + "'>"), (12, "http://com/fr/", ""), (None, "http://lonely.net/#://x.org/", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = {}
    for r in urls.verdicts(df).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.org", "/en/12", "example.org/en/1", "block")]
    assert got[2] == [("example.org", "/es/x", "example.org/es/", "block")]
    assert got[3] == [("notexample.org", "/es/", "org/", "allow")]
    assert got[4] == [("good.net", "/", None, "allow")] and got[5] == [("friend.net", "", None, "allow")]
    assert got[6][0][2:] == ("com/fr/", "allow") and got[7][0][2:] == ("com/de/", "block")
    assert got[8] == [("evil.net", "/p", None, "block")]  # it links to a blocked page's host
    assert got[9] == [("", "", None, "allow")] and got[10] == [("", "", None, "allow")] * 2
    assert got[11] == [("example.org", "", None, "block")]  # its other pages are blocked
    assert got[12][0][2:] == ("com/fr/", "allow") and got[13] == [("", "", None, "allow")] and got[14] == [("y" * 100_000 + ".org", "/" + "z" * 9, "org/", "allow")]
    assert got[None] == [("lonely.net", "/", None, "allow")]
    assert urls.verdicts(df.limit(0)).collect() == []


# -- op8


def test_languages_are_told_apart(spark):
    rnd = random.Random(8)
    words = {"en": ["the", "thing", "other", "with"], "de": ["über", "nicht", "schön", "straße"], "ru": ["это", "слово", "другой", "очень"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang := ["en", "de", "ru"][k % 3], rnd.choice([3, 20, 200])), lang) for k in range(300)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "en"), (1003, "漢字仮名交じり文" * 9, None), (None, text("de", 9), None), (1004, text("en", 30_000), None), (1004, text("en", 3), None)]
    got = langid.language_id(make(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == langid.is_held_out(r.doc_id) for r in got if r.doc_id is not None) and held
    assert all(r.lang_pred == rows[r.doc_id][2] and not r.rejected for r in held)
    assert all((by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0, True) for k in (1000, 1001, 1002))
    assert by[1003].rejected and by[1003].lang_pred in words
    assert by[None].lang_pred == "de" and not by[None].held_out and by[1004].lang_pred == "en"
    kept = langid.accepted(make(spark, rows)).collect()
    assert len(kept) == len(rows) - 4 and len(kept[0]) == len(make(spark, []).columns)


def test_a_slab_changes_no_count(monkeypatch):
    c = [langid.code_points("some words of a text " * 9), langid.code_points("Ähnlich"), langid.code_points("x")]
    whole = langid.counts(c)
    assert whole.sum() == sum(3 * len(x) - 3 for x in c)
    for slab in (1, 2, 7, 16):
        monkeypatch.setattr(langid, "SLAB", slab)
        assert (langid.counts(c) == whole).all()


def plain_grams(text):
    """The n-grams' buckets, in plain Python, of letters in lower case with one space for all else."""
    t = " " + re.sub(r"[^\w]|[\d_]", " ", text.lower())
    c = [ord(x) for x in re.sub(" +", " ", t + " ")]
    m = (1 << 64) - 1
    k = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
    out = {}
    for i, x in enumerate(c):
        one = (x + 1) * k[0] & m
        found = [one * k[3] & m]
        if i + 1 < len(c):
            found.append((one ^ (c[i + 1] * k[1] & m)) * k[2] & m)
        if i + 2 < len(c):
            found.append((found[1] ^ (c[i + 2] * k[3] & m)) * k[1] & m)
        for h in found:
            out[(h >> 40) % langid.DIM] = out.get((h >> 40) % langid.DIM, 0) + 1
    return out


def test_vectors_centroids_and_floor_are_the_plain_ones():
    import math

    rnd = random.Random(3)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(60)] for lang, letters in (("en", "theingodwr"), ("de", "üerbnichtsößa"))}
    rows = [(lang, " ".join(rnd.choice(words[lang]) for _ in range(rnd.choice([5, 9, 40])))) for lang in words for _ in range(30)]
    model = langid.fit(rows)
    rows = sorted(rows)
    tf = [plain_grams(t) for _, t in rows]
    df = {}
    for v in tf:
        for g in v:
            df[g] = df.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(rows)) / (1 + df.get(g, 0))) + 1

    def unit(v):
        n = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()}

    vector = lambda v: unit({g: math.log1p(x) * idf(g) for g, x in v.items()})
    dot = lambda a, b: sum(x * b.get(g, 0) for g, x in a.items())
    centroids = []
    for lang in sorted(words):
        own = [vector(v) for v, (x, _) in zip(tf, rows, strict=True) if x == lang]
        c = [own[int(k * (len(own) - 1) / (langid.CENTROIDS - 1))] for k in range(langid.CENTROIDS)]
        for _ in range(8):
            near = [max(range(len(c)), key=lambda j, v=v: (dot(v, c[j]), -j)) for v in own]
            for j in range(len(c)):
                if j in near:
                    total = {}
                    for v, n in zip(own, near, strict=True):
                        if n == j:
                            for g, x in v.items():
                                total[g] = total.get(g, 0) + x
                    c[j] = unit(total)
        centroids += [(lang, x) for x in c]
    for lang, t in [*rows[:5], *rows[-5:], ("", "nicht the"), ("", "漢字"), ("", "über Straße 12 schöner THING!")]:
        v = vector(plain_grams(t))
        want = max(dot(v, c) for _, c in centroids)
        got = model.predict([t])[0]
        assert abs(got[1] - want) < 1e-4
        assert any(abs(dot(v, c) - want) < 1e-4 and x == got[0] for x, c in centroids)
        length = len(langid.code_points(t)).bit_length()
        assert got[2] == (got[1] < model.floor[min(length, 32)])
    # The floor: REJECT_SHARE of the lowest likeness but one in a thousand of learned texts and stretches of that length.
    assert all(a <= b for a, b in zip(model.floor, model.floor[1:], strict=False)) and 0 < model.floor[-1] < langid.REJECT_SHARE


def test_every_language_is_learned(spark):
    """Labels beyond any number, each with a script of its own; and hot labels are sampled by hashes, repeated rows once."""
    rows = [(k * 300 + j, chr(0x4E00 + k) * (5 + j % 3), f"l{k}") for k in range(280) for j in range(6)]
    rows += [(10**6, "same text", "en")] * 50 + [(10**6 + 1 + k, f"the thing number {'abcdefgh'[k % 8] * (k % 5 + 1)}", "en") for k in range(400)]
    df = make(spark, rows)
    learn = ~langid.held_out("doc_id")
    got = langid.sample(df, "doc_id", "text", "lang", learn)
    by = {}
    for lang, t in got:
        by.setdefault(lang, []).append(t)
    want = {lang for d, _, lang in rows if not langid.is_held_out(d)}
    assert set(by) == want and len(want) > 256
    assert sum(t == "same text" for t in by["en"]) <= 1
    learnable = {(d, t) for d, t, lang in rows if lang == "en" and not langid.is_held_out(d)}
    assert len(by["en"]) == min(langid.PER_LANGUAGE, len(learnable))
    pred = {r.doc_id: r.lang_pred for r in langid.language_id(df).filter("doc_id < 84000").collect()}
    known = [(d, lang) for d, _, lang in rows if d < 84000 and lang in want]
    assert sum(pred[d] == lang for d, lang in known) >= 0.99 * len(known)


# -- op9


def test_a_permutation_and_its_shards(spark, odd_rows):
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(shards.permute_int(x, n) for x in range(n)) == list(range(n))
    got = shards.shard(make(spark, odd_rows)).collect()
    n = len(odd_rows)
    import zlib

    raw = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((d, len(raw(t)) + 1, zlib.crc32(raw(t))) for d, t, _ in odd_rows), key=repr)
    numbered = sorted(((d is not None, d or 0, zlib.crc32(raw(t)), len(raw(t)) + 1) for d, t, _ in odd_rows))
    want = sorted((repr(x[1] if x[0] else None), x[3], p % 16, p // 16) for x, p in zip(numbered, (shards.permute_int(k, n) for k in range(n)), strict=True))
    assert sorted((repr(r.doc_id), r["size"], r.shard, r.slot) for r in got) == want
    per = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in per) and max(map(len, per)) - min(map(len, per)) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_one_id_is_dealt_over_partitions(spark):
    df = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'same' as text")
    got = shards.shard(df).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [312] * 8 + [313] * 8


# -- op10


def test_passages_of_the_benchmark(spark, odd_rows):
    rnd = random.Random(10)
    base = next(t for d, t, _ in odd_rows if d == 3)
    items = [(1, base[:200]), (2, "Same ID, Other; text"), (2, None), (None, "one"), (3, ""), (10, prose(rnd, 30)), (11, base.upper()[150:400])]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, items string")
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000]
    named = [("" if k is None else k, t) for k, t in items]
    want = sorted(decontam.reference([(d, t) for d, t, _ in rows], named), key=repr)
    assert rows_of(decontam.digest(decontam.contamination(make(spark, rows), bench))) == want
    assert rows_of(decontam.digest(decontam.contamination(make(spark, rows), bench, block_bytes=100))) == want
    clean = decontam.clean(make(spark, rows), bench, block_bytes=100).collect()
    assert sorted((r.doc_id for r in clean), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)
    none = decontam.digest(decontam.contamination(make(spark, rows), bench.limit(0))).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_pieces_of_a_text_change_nothing(monkeypatch):
    rnd = random.Random(11)
    text = prose(rnd, 400, 30).encode()
    found = decontam.tables([(1, " ".join(text.decode().split()[100:140])), (2, "w1 w2")])
    whole = decontam.find(text, found)
    monkeypatch.setattr(decontam.pieces, "__defaults__", (50,))
    assert decontam.find(text, found) == whole


# -- op3, long runs


def test_a_run_of_tokens_is_decoded_as_one_sequence():
    rnd, f = np.random.default_rng(3), pii.Field()
    f.w, f.t = rnd.normal(size=f.w.shape), rnd.normal(size=f.t.shape)
    words = ["x1", "12", "a@b", "555-01", "at", "dot", "3.4", "co", "77777", "7"]
    for n in (1, 9, 40, 300):
        text = " ".join(rnd.choice(words, n))
        for run in pii.windows(text):
            want = f.best(pii.Window(text, run))
            assert all(f.decode(text, run, piece, kept) == want for piece, kept in ((1, 5), (7, 10**6), (64, 100), (128, 40)))


def test_an_entity_is_found_wherever_it_stands():
    text = lambda k: " ".join(["x1"] * k + ["bob at example dot co dot uk", "and then"])
    plain = ["write to amy@example.org or call +1 555 010 9999 now 5"] * 30
    field, found = pii.fit(plain), []
    for k in range(0, 201):
        spans = pii.all_spans(text(k), field)[1]
        found.append([(kind, a - 3 * k, b - 3 * k) for kind, a, b in spans if a >= 3 * k])
    assert all(x == found[20] for x in found[20:])
