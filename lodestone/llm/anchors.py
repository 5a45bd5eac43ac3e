"""Substring dedup by fixed-block anchors.

Every document's words are cut into reference blocks of BLOCK words that don't overlap. Each rolling run of BLOCK words
probes the index of these blocks: any repeat of WINDOW words or more holds a whole block of the earlier document. Hits
are anchors. From each, and from the block that it hit, the repeat is extended to both sides: all windows that hold an
anchor are compared with all others of the documents that met, and the union of equal windows is the maximal repeat.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, table
from .hashing import buffers, runs, words
from .repeats import BITS, NO_ID, bucket_count, entered, firsts, gathered, least_most, merged, met, places, slabs, source

WINDOW = 13
#: 2 * BLOCK - 1 <= WINDOW, so that any window holds a whole block, wherever the blocks begin.
BLOCK = (WINDOW + 1) // 2
_U = np.uint64


def _slab(batch: pa.RecordBatch) -> tuple:
    """(ids, fps, word hashes, each word's document, each word's place in it, words left in it)."""
    raw, bounds = buffers(batch.column(batch.schema.get_field_index("text")))
    h, start, _ = words(raw, bounds)
    cut = np.searchsorted(start, bounds)
    n = np.diff(cut)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - np.repeat(cut[:-1], n)
    left = np.repeat(n, n) - at
    ids, fps = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "fp"))
    return ids, fps, h, doc, at, left


def probe(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors of each document: where a run of BLOCK words is a block of an earlier one, or a block is a run of a later one."""

    def entries(batches, buckets):
        for batch in slabs(batches):
            ids, fps, h, doc, at, left = _slab(batch)
            k = np.flatnonzero(left >= BLOCK)
            key = runs(h[:, 0], BLOCK)[k] >> _U(64 - BITS) if len(k) else np.empty(0, np.uint64)
            yield from entered(buckets, ids, fps, key, np.zeros(len(k), np.uint8), doc[k], at[k].astype(np.uint32), _anchored)

    return met(docs, entries, lambda *x: _answer(_anchored, *x), buckets, np.uint8, np.uint32, _anchored)


def _answer(settle, h: np.ndarray, c: np.ndarray, doc: np.ndarray, fp: np.ndarray, p: np.ndarray, settled) -> list[pa.Table]:
    order = np.lexsort((c, h))
    h, c, doc, fp, p = h[order], c[order], doc[order], fp[order], p[order]
    _, found = settle(h, c, doc, p)
    return [places(doc[found], fp[found], p[found], 0), places(*settled, 0)]


def _anchored(key: np.ndarray, _: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key: (settled here: in a later document than some block, anchors)."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    starts = firsts(key)
    block = p % BLOCK == 0
    first, _ = least_most(np.where(block, doc, NO_ID), starts)
    _, last = least_most(doc, starts)
    later = doc > first
    return later, later | (block & (doc < last))


def extend(docs: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """Where windows begin that hold an anchor and are also in an earlier document."""
    joined = docs.join(anchors, ["doc_id", "fp"]).select("doc_id", "fp", "text", F.col("p0").alias("p"))

    def entries(batches, buckets):
        for batch in slabs(batches):
            ids, fps, h, doc, at, left = _slab(batch)
            n = len(h)
            first = np.flatnonzero(at == 0)
            base = np.zeros(len(ids), np.int64)
            base[doc[first]] = first
            marked = np.zeros(n + 1, np.int64)
            for k, blobs in enumerate(batch.column(batch.schema.get_field_index("p")).to_pylist()):
                own = merged(blobs) + base[k]
                np.add.at(marked, np.maximum(own - (WINDOW - BLOCK), base[k]), 1)
                np.add.at(marked, own + 1, -1)
            k = np.flatnonzero((np.cumsum(marked)[:n] > 0) & (left >= WINDOW))
            key, other = (runs(h[:, x], WINDOW)[k] if len(k) else np.empty(0, np.uint64) for x in (0, 1))
            yield from entered(buckets, ids, fps, key >> _U(64 - BITS), other, doc[k], at[k].astype(np.uint32), _later)

    return met(joined, entries, lambda *x: _answer(_later, *x), buckets, np.uint64, np.uint32, _later)


def _later(key: np.ndarray, check: np.ndarray, doc: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key and check: those that an earlier document has too, which are settled and found."""
    later = doc > least_most(doc, firsts(key, check))[0] if len(key) else np.zeros(0, bool)
    return later, later


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256, and kept (the words that stay) unless texts is false.

    A word goes if a window of WINDOW words that holds it also begins in a document of a smaller id. Null and empty
    texts have no words, and neither they nor texts of fewer than WINDOW words lose any. A null id is larger than all
    others, and rows that share an id (or have none), repeated rows among them, don't make each other's words go. A
    text of any length is read whole, in one task; so is a word. Windows are equal if 112 bits of two hashes are, each
    made of its own half of the words' 128-bit BLAKE2b. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """
    src = source(docs, id_col, text_col)
    n = bucket_count(src)
    anchors = materialize(gathered(materialize(probe(src, n), "anchors")), "anchors-by-document")
    found = materialize(extend(src, anchors, n), "repeats")
    gone = src.join(gathered(found), ["doc_id", "fp"], "left").select("doc_id", "text", F.col("p0").alias("p"))

    def run(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if texts else {})
            for text, blobs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = text.as_buffer().to_pybytes().split()
                n, start = len(own), merged(blobs)
                if len(start):
                    edge = np.zeros(n + 1, np.int64)
                    edge[start] += 1
                    np.add.at(edge, start + WINDOW, -1)
                    own = list(compress(own, (np.cumsum(edge)[:n] == 0).tolist()))
                kept = b" ".join(own)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(own))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["kept"].append(kept.decode("utf-8", "replace"))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), *([pa.array(out["kept"], pa.string())] if texts else [])], ["doc_id", *out])

    made = gone.mapInArrow(run, OUT if texts else OUT.rpartition(",")[0])
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_block_anchors(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM k JOIN m USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
t AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM t
"""
