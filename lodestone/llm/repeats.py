"""What the two searches for repeats share: hashes meet in buckets, answers go back to documents.

A map task turns a slab of text into entries (hash, document, place). It sorts them, settles what it can within the
slab, and packs the rest for each bucket of hashes into one row. So a hash that a third of all documents have enters
its bucket a few times for each slab, not for each document. A bucket's task sorts its entries and answers with places
for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a slab, and of all text for each bucket; the fewest buckets; the most that a slab is dealt to at
#: once: with more, rows go to so many first, are joined there, and are dealt again.
SLAB, PER_BUCKET, BUCKETS, FAN = 8 << 20, 8 << 20, 32, 4096
#: Entries that are joined before they are dealt again; buckets in one partition.
JOINED, AT_ONCE = 1 << 20, 8
#: Bits of a packed hash.
BITS = 48
NO_ID = (1 << 63) - 1
_ZSTD = pa.Codec("zstd", 1)
PACKED = "bucket int, ids binary, fps binary, h binary, c binary, d binary, p binary, rd binary, rp binary"
_PACKED = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("ids", "fps", "h", "c", "d", "p", "rd", "rp"))])
PLACES = "doc_id long, fp long, kind int, places binary"
_PLACES = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("kind", pa.int32()), ("places", pa.binary())])


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null as NO_ID, so that it is larger than all others), fp, text. Rows that repeat id and text are alike in every result, so id and fp name them: fp is the text's hash, or 0 where no id is repeated, which takes no room on the way."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    repeated = not docs.groupBy(own.alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return docs.select(own.alias("doc_id"), F.xxhash64(text).alias("fp") if repeated else F.lit(0).cast("long").alias("fp"), text.alias("text"))


def bucket_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(BUCKETS, -(-total // PER_BUCKET))


def coded(a: np.ndarray, rising: bool = False) -> bytes:
    """Compressed, byte plane by byte plane; rising numbers by their steps."""
    if rising and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def decoded(b: bytes, dtype, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(_ZSTD.decompress(b[8:], n, asbytes=True), np.uint8).reshape(size, n // size)
    a = np.ascontiguousarray(raw.T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if rising else a


def pack(buckets: int, ids: np.ndarray, fps: np.ndarray, h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray, rd: np.ndarray, rp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries (hash under 2^BITS, check, document's number, place), and settled ones (rd, rp), as a row for each bucket."""
    order = np.argsort(h, kind="stable")
    h, c, d, p = h[order], c[order], d[order], p[order]
    at = ((h >> np.uint64(BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(at, np.arange(buckets + 1).astype(np.uint64))
    out = {name: [] for name in _PACKED.names}
    to = int(h[0] if len(h) else rp[0] if len(rp) else 0) % buckets  # where settled ones pass through
    for b in range(buckets):
        s, e = int(cut[b]), int(cut[b + 1])
        own = b == to and len(rd) > 0
        if s == e and not own:
            continue
        used, inverse = np.unique(np.concatenate([d[s:e], rd]) if own else d[s:e], return_inverse=True)
        out["bucket"].append(b)
        out["ids"].append(coded(ids[used]))
        out["fps"].append(coded(fps[used]))
        out["h"].append(coded(h[s:e], rising=True))
        out["c"].append(coded(c[s:e]))
        out["d"].append(coded(inverse[: e - s].astype(np.uint32)))
        out["p"].append(coded(p[s:e]))
        out["rd"].append(coded(inverse[e - s :].astype(np.uint32)))
        out["rp"].append(coded(rp if own else rp[:0]))
    if out["bucket"]:
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PACKED], schema=_PACKED)


def unpack(group: pa.Table, check, place) -> tuple[np.ndarray, ...]:
    """(h, c, doc, fp, p) of all entries, (doc, fp, p) of all that are settled."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    for row in zip(*(group.column(x).to_pylist() for x in ("ids", "fps", "h", "c", "d", "p", "rd", "rp")), strict=True):
        ids, fps = decoded(row[0], np.int64), decoded(row[1], np.int64)
        d, rd = decoded(row[4], np.uint32), decoded(row[6], np.uint32)
        for k, x in enumerate((decoded(row[2], np.uint64, True), decoded(row[3], check), ids[d], fps[d], decoded(row[5], place), ids[rd], fps[rd], decoded(row[7], place))):
            parts[k].append(x)
    return tuple(np.concatenate(x) for x in parts)


def places(doc: np.ndarray, fp: np.ndarray, p: np.ndarray, kind: int) -> pa.Table:
    """A row for each document: its places, sorted."""
    if not len(doc):
        return _PLACES.empty_table()
    order = np.lexsort((p, fp, doc))
    doc, fp, p = doc[order], fp[order], p[order]
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1]) | (p[1:] != p[:-1])])
    doc, fp, p = doc[keep], fp[keep], p[keep]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])]))
    ends = np.append(cut, len(doc))
    raw = p.astype(np.uint64).tobytes()
    blob = pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(doc[cut]), pa.array(fp[cut]), pa.array(np.full(len(cut), kind, np.int32)), blob], schema=_PLACES)


def slabs(batches: Iterator[pa.RecordBatch], limit: int = SLAB) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their text exceeds the limit; a longer text comes alone."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        size = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)) if len(text) else np.empty(0)
        s, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield batch.slice(s, i - s)
                s, held = i, 0
            held += n
        if s < batch.num_rows:
            yield batch.slice(s)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def least_most(doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest document of each run, for each entry."""
    reps = np.diff(np.append(starts, len(doc)))
    return np.repeat(np.minimum.reduceat(doc, starts), reps), np.repeat(np.maximum.reduceat(doc, starts), reps)


def gathered(found: DataFrame) -> DataFrame:
    """A row for each document: the lists of places by kind."""
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("places"))).alias(f"p{k}")
    return found.groupBy("doc_id", "fp").agg(of(0), of(1), of(2))


def merged(blobs: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs), np.uint64)).astype(np.int64) if blobs else np.empty(0, np.int64)


def entered(buckets: int, ids: np.ndarray, fps: np.ndarray, h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray, settle: Callable, rd: np.ndarray | None = None, rp: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Entries packed, without those that can be settled among themselves. settle: see met()."""
    order = np.lexsort((c, h))
    h, c, d, p = h[order], c[order], d[order], p[order]
    later, found = settle(h, c, ids[d], p)
    rd = d[found] if rd is None else np.concatenate([rd, d[found]])
    rp = p[found] if rp is None else np.concatenate([rp, p[found]])
    yield from pack(buckets, ids, fps, h[~later], c[~later], d[~later], p[~later], rd, rp)


def nothing_settled(h: np.ndarray, c: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(h), bool), np.zeros(len(h), bool)


def dealt_again(batches: Iterator[pa.RecordBatch], buckets: int, check, place, settle: Callable) -> Iterator[pa.RecordBatch]:
    """Packed rows, joined, settled among themselves once more, and packed for more buckets."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, c, doc, fp, p, rdoc, rfp, rp = unpack(pa.Table.from_batches(held), check, place)
        pairs, number = np.unique(np.stack([np.concatenate([doc, rdoc]), np.concatenate([fp, rfp])]), axis=1, return_inverse=True)
        number = number.ravel()
        yield from entered(buckets, pairs[0], pairs[1], h, c, number[: len(doc)], p, settle, number[len(doc) :], rp)

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            held.append(row)
            size += int.from_bytes(row.column(2 + 1)[0].as_buffer().to_pybytes()[:8], "little") // 8 + 1
            if size >= JOINED:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """rows over as many partitions as keep each to AT_ONCE buckets or so; below the session's number of partitions it stays."""
    n = -(-buckets // AT_ONCE)
    return rows.repartition(n, "bucket") if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def met(docs: DataFrame, entries: Callable, answer: Callable, buckets: int, check, place, settle: Callable = nothing_settled) -> DataFrame:
    """entries(batches, buckets) gives packed rows; answer(h, c, doc, fp, p, settled) gives tables of places for one bucket.

    settle(h, c, doc, p), of entries sorted by h and c, tells (which need go no further, which are found). With many
    buckets, entries are dealt in two rounds and settled in between: so a hash that all slabs have reaches its bucket
    in as few entries as there are joined rows of many slabs.
    """

    def group(table: pa.Table) -> pa.Table:
        h, c, doc, fp, p, *settled = unpack(table, check, place)
        return pa.concat_tables([*answer(h, c, doc, fp, p, settled), _PLACES.empty_table()])

    first = min(buckets, FAN)
    rows = docs.mapInArrow(lambda batches: entries(batches, first), PACKED)
    if buckets > first:
        n = min(first, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // AT_ONCE)))
        rows = rows.repartition(n, "bucket").mapInArrow(lambda batches: dealt_again(batches, buckets, check, place, settle), PACKED)
    return by_bucket(rows, buckets).groupBy("bucket").applyInArrow(lambda t: group(t), PLACES)
