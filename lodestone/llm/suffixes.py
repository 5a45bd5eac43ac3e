"""Suffix-array dedup over bytes, by a hash-compared suffix sort.

Prefix polynomial hashes give the hash of any stretch in one step, and binary search over lengths gives the common
extension of two suffixes; a mergesort that compares so sorts the suffixes, in a number of steps that grows with the
logarithm of their common length. Suffixes that agree in WINDOW bytes are compared byte by byte and go on as one. The
sorted suffixes are verified byte by byte as well; where hashes misled the sort, it is done again without them.

The suffixes are dealt to tasks by anchors: of each window of WINDOW bytes, the GRAM bytes with the smallest hash. Equal
windows have equal anchors. Adjacent windows with one anchor are a stretch. Hashes only tell which anchors several
documents have; the bytes of their stretches meet, and bytes decide.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, table
from .hashing import _INVERSE, buffers, mix, prefix
from .repeats import BITS, NO_ID, bucket_count, by_bucket, firsts, gathered, least_most, merged, met, pack, places, slabs, source

WINDOW = 50
GRAM = 25
#: Stretches with one anchor (for each slab, each once) that meet in one task; of more, each window is dealt by itself.
HOT = 2048
#: Buckets of stretches for each bucket of hashes: their bytes, places and suffixes take more room.
FINER = 4
#: Bytes whose anchors are sought at once; a longer document is read in parts that overlap by a window.
PART = 1 << 18
_U = np.uint64


def stretches(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window's place, last window's, anchor's place, anchor's hash, stretch's hash); places in the document."""
    out: list[tuple[np.ndarray, ...]] = []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART, "right")) - 1)
        if bounds[j] - bounds[i] <= 2 * PART - WINDOW:
            out.append(_part(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i, 0))
        else:
            for at in range(int(bounds[i]), int(bounds[i + 1]) - WINDOW + 1, PART):
                end = min(int(bounds[i + 1]), at + PART + WINDOW - 1)
                out.append(_part(raw[at:end], np.array([0, end - at]), i, at - int(bounds[i])))
        i = j
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, k) for k in kinds)


def _part(b: np.ndarray, bounds: np.ndarray, first: int, shift: int) -> tuple[np.ndarray, ...]:
    n = len(b)
    m = n - WINDOW + 1
    if m <= 0:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = prefix(b)
    gram = mix((h[GRAM:] - h[:-GRAM]) * _INVERSE[: n - GRAM + 1])
    span = WINDOW - GRAM + 1
    low = (gram >> _U(22) << _U(22)) | np.arange(len(gram), dtype=np.uint64)  # the smallest hash, the leftmost on a tie
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    anchor = (low & _U((1 << 22) - 1)).astype(np.int64)[:m]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:m]
    valid = np.arange(m) + WINDOW <= bounds[1:][doc]
    new = np.ones(m, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new & valid)
    # A stretch ends before the next begins, or with its document's last window.
    edge = np.flatnonzero(new | ~valid)
    k = np.searchsorted(edge, begin, "right")
    last = np.where(k < len(edge), edge[np.minimum(k, len(edge) - 1)], m) - 1
    a, d = anchor[begin], doc[begin]
    whole = mix((h[last + WINDOW] - h[begin]) * _INVERSE[begin] + (last - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    base = bounds[:-1][d] - shift
    return d + first, begin - base, last - base, a - base, mix(gram[a] + _U(1)), whole  # mixed again: the smallest hashes are all small


def _place(s0: np.ndarray, s1: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (s0.astype(np.uint64) << _U(16)) | ((a - s0).astype(np.uint64) << _U(8)) | (s1 - s0).astype(np.uint64)


def _loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers that compare as bytes do."""
    return np.ndarray(max(0, len(raw) - 7), ">u8", np.ascontiguousarray(raw).data if len(raw) else b"", 0, (1,)) if len(raw) >= 8 else np.empty(0, ">u8")


def same_bytes(raw: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes (8 at least) from i and from j on are the same."""
    out, load = np.ones(len(i), bool), _loads(raw)
    for k in range(0, int(n.max(initial=0)), 8):
        at = np.minimum(k, n - 8)
        out &= load[i + at] == load[j + at]
    return out


def survey(docs: DataFrame, buckets: int) -> DataFrame:
    """Places by document: of kind 0, stretches that an earlier document has, byte by byte; of kind 1, those whose anchors several documents have; of kind 2, such of hot anchors."""

    def entries(batches, buckets):
        for batch in slabs(batches):
            ids, fps = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "fp"))
            raw, bounds = buffers(batch.column(batch.schema.get_field_index("text")))
            d, s0, s1, a, key, whole = stretches(raw, bounds)
            key = key >> _U(64 - BITS)
            order = np.lexsort((ids[d], whole, key))
            d, s0, s1, a, key, whole = (x[order] for x in (d, s0, s1, a, key, whole))
            starts = firsts(key, whole)
            first = np.repeat(starts, np.diff(np.append(starts, len(key))))
            # A copy of a stretch of the slab's least document with its hash is settled here, by its bytes.
            later = np.flatnonzero((ids[d] > ids[d[first]]) & (s1 - s0 == (s1 - s0)[first]) & (a - s0 == (a - s0)[first]))
            begin = bounds[d] + s0
            later = later[same_bytes(raw, begin[later], begin[first[later]], (s1 - s0 + WINDOW)[later])]
            keep = np.ones(len(key), bool)
            keep[later] = False
            p = _place(s0, s1, a)
            yield from pack(buckets, ids, fps, key[keep], whole[keep], d[keep], p[keep], d[later], p[later])

    def answer(h, c, doc, fp, p, settled):
        if not len(h):
            return [places(*settled, 0)]
        order = np.argsort(h, kind="stable")
        h, doc, fp, p = h[order], doc[order], fp[order], p[order]
        starts = firsts(h)
        low, high = least_most(doc, starts)
        size = np.diff(np.append(starts, len(h)))
        kind = np.where(low < high, np.where(np.repeat(size, size) > HOT, 2, 1), 0)
        return [*(places(doc[kind == k], fp[kind == k], p[kind == k], k) for k in (1, 2)), places(*settled, 0)]

    return met(docs, entries, answer, buckets, np.uint64, np.uint64)


# -- sorting suffixes


class Text:
    """Bytes with prefix polynomial hashes, in rows that start anew; suffixes are compared up to WINDOW bytes."""

    def __init__(self, b: np.ndarray):
        from .hashing import _P, powers

        self.b = np.concatenate([b, np.zeros(WINDOW, np.uint8)])
        n = len(self.b)
        self.h = np.zeros(n + 1, np.uint64)
        up = powers(_P, n)
        np.cumsum((self.b.astype(np.uint64) + _U(1)) * up[:n], out=self.h[1:])
        self.inverse = powers(pow(_P, -1, 1 << 64), n)

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.h[i + length] - self.h[i]) * self.inverse[i] == (self.h[j + length] - self.h[j]) * self.inverse[j]

    def hashes(self, i: np.ndarray) -> np.ndarray:
        """Of the WINDOW bytes from each place on."""
        return (self.h[i + WINDOW] - self.h[i]) * self.inverse[i]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes, up to WINDOW, suffixes i and j share; by binary search over hashes."""
        out = np.full(len(i), WINDOW)
        rest = np.flatnonzero(~self.same(i, j, np.int64(WINDOW)))  # most suffixes that meet here are equal
        i, j = i[rest], j[rest]
        lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), WINDOW - 1)
        for _ in range(WINDOW.bit_length()):
            mid = (lo + hi + 1) >> 1
            ok = self.same(i, j, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.maximum(mid - 1, lo))
        out[rest] = lo
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = self.common(i, j)
        return (k < WINDOW) & (self.b[i + np.minimum(k, WINDOW - 1)] < self.b[j + np.minimum(k, WINDOW - 1)])

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Byte by byte."""
        return same_bytes(self.b, i, j, np.full(len(i), WINDOW))

    def columns(self, i: np.ndarray) -> list[np.ndarray]:
        """The WINDOW bytes from each place on, 8 by 8, as numbers that compare as bytes do."""
        load = _loads(self.b)
        return [load[i + min(k, WINDOW - 8)].astype(np.uint64) for k in range(0, WINDOW, 8)]


def suffix_sort(text: Text, suffix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the distinct suffixes of each group in order (group is sorted), and for each suffix the one that stands for it.

    A bottom-up mergesort, all groups at a time. Each suffix of a right run finds its place in the left run by binary
    search; one that is there already is dropped, so many equal suffixes cost little more than a few.
    """
    n = len(suffix)
    same, items = np.arange(n), np.arange(n)
    starts = firsts(group)
    size = np.diff(np.append(starts, n))
    of, run = np.repeat(np.arange(len(starts)), size), np.arange(n) - np.repeat(starts, size)
    while run.any():
        block = firsts(of, run)
        number = np.repeat(np.arange(len(block)), np.diff(np.append(block, len(items))))
        right, s = np.flatnonzero(run & 1), suffix[items]
        lo, last = block[number[right] - 1], block[number[right]]
        hi = last.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            goes = text.less(s[mid], s[right[open_]])
            lo[open_], hi[open_] = np.where(goes, mid + 1, lo[open_]), np.where(goes, hi[open_], mid)
        met_ = np.flatnonzero(lo < last)
        met_ = met_[text.equal(s[lo[met_]], s[right[met_]])]
        same[items[right[met_]]] = items[lo[met_]]
        keep = np.ones(len(items), bool)
        keep[right[met_]] = False
        held = np.concatenate([[0], np.cumsum(keep)])  # how many stay, before each place
        stay = keep[right]
        lo, right = lo[stay], right[stay]
        # A left suffix moves by the right ones at or before it; a right one by the left ones before it.
        before = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=len(items)))])
        own = block[number]
        to = np.arange(len(items)) - own + before[np.arange(len(items)) + 1] - before[own]
        to[right] = lo - block[number[right] - 1] + held[right] - held[own[right]]
        pair = firsts(of, run >> 1)
        to += held[np.repeat(pair, np.diff(np.append(pair, len(items))))]
        left = np.flatnonzero(keep)
        new = np.empty(len(left), np.int64)
        new[to[left]] = items[left]
        items, of, run = new, of[left], run[left] >> 1
    while (same[same] != same).any():
        same = same[same]
    return items, same


def sorted_classes(text: Text, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each suffix the number of its class of equal ones; exact, whatever the hashes are."""
    order, same = suffix_sort(text, suffix, group)
    found = text.columns(suffix[order])
    less, open_ = np.zeros(max(0, len(order) - 1), bool), np.ones(max(0, len(order) - 1), bool)
    for x in found:
        less |= open_ & (x[:-1] < x[1:])
        open_ &= x[:-1] == x[1:]
    if (less | (group[order][1:] != group[order][:-1])).all():
        return same
    own = np.lexsort((*text.columns(suffix)[::-1], group))  # hashes misled a comparison: by bytes alone
    new = firsts(group[own], *(x[own] for x in text.columns(suffix)))
    out = np.empty(len(suffix), np.int64)
    out[own] = np.repeat(own[new], np.diff(np.append(new, len(own))))
    return out


def sort_open(docs: DataFrame, surveyed: DataFrame, buckets: int) -> DataFrame:
    """Places of windows that begin in stretches whose anchors several documents have, and that an earlier document has."""
    wanted = surveyed.filter((F.size("p1") > 0) | (F.size("p2") > 0))
    joined = docs.join(wanted, ["doc_id", "fp"]).select("doc_id", "fp", "text", "p1", "p2")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["bucket", "doc", "fp", "s0", "a", "bytes"]

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    def single(windows: list[tuple[bytes, int, int, int, int]]) -> pa.RecordBatch:
        """Windows dealt by themselves. Of those with the same bytes, only the least documents' go on; for the others it is settled."""
        least: dict[bytes, int] = {}
        for w, doc, *_ in windows:
            if least.setdefault(w, doc) > doc:
                least[w] = doc
        out: list[list] = [[] for _ in names]
        for w, doc, fp, at, a in windows:
            later = doc > least[w]
            for x, v in zip(out, (zlib.crc32(w) % buckets, doc, fp, at, a, None if later else w), strict=True):
                x.append(v)
        return rows(out)

    def entries(batches):
        for batch in batches:
            ids, fps = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "fp"))
            texts, some, hot = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "p1", "p2"))
            out: list[list] = [[] for _ in names]
            windows: list[tuple[bytes, int, int, int, int]] = []
            for k in range(batch.num_rows):
                raw, doc, fp = texts[k].as_buffer().to_pybytes(), ids[k], fps[k]
                p = merged(some[k].as_py())
                s0, back, span = (p >> 16).tolist(), ((p >> 8) & 255).tolist(), ((p & 255) + WINDOW).tolist()
                out[0] += [zlib.crc32(raw[s + a : s + a + GRAM]) % buckets for s, a in zip(s0, back, strict=True)]
                out[1] += [doc] * len(s0)
                out[2] += [fp] * len(s0)
                out[3] += s0
                out[4] += back
                out[5] += [raw[s : s + n] for s, n in zip(s0, span, strict=True)]
                for x in merged(hot[k].as_py()).tolist():
                    s, a = x >> 16, (x >> 16) + ((x >> 8) & 255)
                    windows += [(raw[w : w + WINDOW], doc, fp, w, a - w) for w in range(s, s + (x & 255) + 1)]
                if len(out[0]) > 50_000:
                    yield rows(out)
                    out = [[] for _ in names]
                if len(windows) > 200_000:
                    yield single(windows)
                    windows = []
            if out[0]:
                yield rows(out)
            if windows:
                yield single(windows)

    dealt = joined.mapInArrow(entries, "bucket int, doc long, fp long, s0 long, a int, bytes binary")

    def answer(group: pa.Table) -> pa.Table:
        told = group.filter(group.column("bytes").is_null())
        doc, fp, s0 = (told.column(c).to_numpy() for c in ("doc", "fp", "s0"))
        group = group.filter(group.column("bytes").is_valid())
        open_ = [group.column(c).to_numpy() for c in ("doc", "fp", "s0", "a")]
        return pa.concat_tables([places(doc, fp, _place(s0, s0, s0), 0), sorted_places(*open_, group.column("bytes").combine_chunks())])

    return by_bucket(dealt, buckets).groupBy("bucket").applyInArrow(lambda t: answer(t), "doc_id long, fp long, kind int, places binary")


def sorted_places(doc: np.ndarray, fp: np.ndarray, s0: np.ndarray, a: np.ndarray, rows: pa.BinaryArray) -> pa.Table:
    """What rows (stretches, with a the anchor's place in each) have in common with an earlier document's."""
    if not len(rows):
        return places(doc, fp, s0, 0)
    # Rows of the same bytes are sorted as one, which the least document stands for.
    coded = rows.dictionary_encode()
    code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    order = np.lexsort((doc, code))
    doc, fp, s0, a, code = doc[order], fp[order], s0[order], a[order].astype(np.int64), code[order]
    starts = firsts(code)
    least = doc[starts]
    later = doc > least[code]
    raw = np.frombuffer(distinct.buffers()[2], np.uint8)
    bounds = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, 4 * distinct.offset).astype(np.int64)
    text = Text(raw[bounds[0] : bounds[-1]])
    start, n = bounds[:-1] - bounds[0], np.diff(bounds) - WINDOW + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    suffix = start[row] + offset
    # A suffix whose hash no other has begins nothing that is repeated.
    h = text.hashes(suffix)
    by = np.argsort(h, kind="stable")
    new = firsts(h[by])
    size = np.diff(np.append(new, len(by)))
    pick = np.sort(by[np.repeat(size > 1, size)])
    suffix, row, offset = suffix[pick], row[pick], offset[pick]
    # Equal windows have equal anchors at equal distance, so suffixes are sorted for each such pair.
    back = a[starts]
    key = mix((text.h[start + back + GRAM] - text.h[start + back]) * text.inverse[start + back])[row] ^ mix((back[row] - offset).astype(np.uint64) + _U(1))
    pre = np.argsort(key, kind="stable")
    suffix, row, offset, key = suffix[pre], row[pre], offset[pre], key[pre]
    found = [places(doc[later], fp[later], _place(s0[later], s0[later] + (n - 1)[code[later]], s0[later] + a[later]), 0)]
    if len(suffix):
        same = sorted_classes(text, suffix, key)
        first = np.full(len(suffix), NO_ID)
        np.minimum.at(first, same, least[row])
        gone = least[row] > first[same]
        row, offset = row[gone], offset[gone]
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        # Adjacent windows are told as one stretch; rows of the least document, which may be repeated, all have them.
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])[: len(row)])
        end = np.append(begin[1:], len(row)) - 1
        of, at, to = row[begin], offset[begin], offset[end] if len(begin) else offset[:0]
        own = np.flatnonzero(~later)
        cut0, cut1 = np.searchsorted(of, code[own]), np.searchsorted(of, code[own], "right")
        times = cut1 - cut0
        which = np.repeat(own, times)
        x = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(cut0, times)
        found.append(places(doc[which], fp[which], _place(s0[which] + at[x], s0[which] + to[x], s0[which] + at[x]), 0))
    return pa.concat_tables(found)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256, and kept (the bytes that stay; they may cut characters) unless texts is false.

    A byte goes if WINDOW bytes that hold it also begin in a document of a smaller id. Null and empty texts have no
    bytes, and neither they nor texts of fewer than WINDOW bytes lose any. A null id is larger than all others, and
    rows that share an id (or have none), repeated rows among them, don't make each other's bytes go. A text of any
    length is read whole, in one task. Every removal is decided by a comparison of bytes. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    src = source(docs, id_col, text_col)
    n = bucket_count(src)
    found = materialize(survey(src, n), "stretches")
    by_doc = materialize(gathered(found), "stretches-by-document")
    drop(found)
    sorted_ = materialize(sort_open(src, by_doc, FINER * n), "sorted")
    gone = gathered(by_doc.select("doc_id", "fp", F.lit(0).alias("kind"), F.explode("p0").alias("places")).unionByName(sorted_))
    joined = src.join(gone, ["doc_id", "fp"], "left").select("doc_id", "text", F.col("p0").alias("p"))

    def run(batches):
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if texts else {})
            for text, blobs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, p = text.as_buffer().to_pybytes(), merged(blobs)
                kept, spans = raw, 0
                if len(p):
                    s0, s1 = p >> 16, (p >> 16) + (p & 255) + WINDOW
                    reach = np.maximum.accumulate(s1)  # p is sorted by s0
                    begin = np.flatnonzero(np.concatenate([[True], s0[1:] > reach[:-1]]))
                    stop = reach[np.append(begin[1:], len(s0)) - 1]
                    spans, at, parts = len(begin), 0, []
                    for x, y in zip(s0[begin].tolist(), stop.tolist(), strict=True):
                        parts.append(raw[at:x])
                        at = y
                    kept = b"".join([*parts, raw[at:]])
                for c, v in zip(out, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False))], ["doc_id", *out])

    made = joined.mapInArrow(run, OUT if texts else OUT.rpartition(",")[0])
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op6_suffix_sort(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False)


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * WINDOW}) AS s FROM (SELECT doc_id, x, unnest(range(0, n - {WINDOW - 1})) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT doc_id, i FROM w JOIN m USING (s) WHERE doc_id > first),
e AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW}, true) AS new FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM e) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
