"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items, as sequences of words. For all patterns of one length m, a
shift table holds for each pair of adjacent words how far the search may move on without passing an occurrence; where
it may not move, the words' last pair names a bucket of patterns, and their words are compared one by one.
Documents are only scanned, never shuffled. The benchmark is read in blocks of a bounded size, each searched for in a
pass of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import in_turn
from .common import fresh, table

WINDOW = 10
#: Benchmark text in one block, in bytes.
BLOCK_BYTES = 8 << 20
#: Bytes of a document that are split into words at once.
PIECE = 1 << 20

#: Word bytes stay (A-Z lower-cased), all others become a space. Bytes from 0x80 on are parts of word characters.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_TABLE).split()


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of raw, some at a time."""
    if len(raw) <= size:
        yield raw.translate(_TABLE).split()
        return
    flat, at = raw.translate(_TABLE), 0
    while at < len(flat):
        end = at + size
        if end < len(flat):
            end = flat.find(b" ", end)
            end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


class Patterns:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.pair = m, min(2, m)
        self.far = m - self.pair + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, items in patterns.items():
            for end in range(self.pair, m + 1):
                key = p[end - 2 : end] if self.pair == 2 else p[0]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets.setdefault(p[-2:] if self.pair == 2 else p[0], []).append((p, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence, by start."""
        m, far, get, n = self.m, self.far, self.shift.get, len(words)
        if self.pair == 1:
            for i, w in enumerate(words):
                for _, items in self.buckets.get(w, ()):
                    yield i, items
            return
        i = m - 1
        while i < n:
            s = get((words[i - 1], words[i]), far)
            if s:
                i += s
                continue
            start = i - m + 1
            for p, items in self.buckets[words[i - 1], words[i]]:
                if words[start] == p[0] and tuple(words[start : i + 1]) == p:
                    yield start, items
            i += 1


def tables(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """items: (number, text). An item of fewer words than the window, but not none, is one pattern."""
    by: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, text in items:
        words = words_of(text)
        if words:
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                held = by.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
                if not held or held[-1] != k:
                    held.append(k)
    return [Patterns(m, p) for m, p in sorted(by.items())]


def find(raw: bytes, found: list[Patterns]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The number of words, the hit spans of words (merged), and the items. Occurrences across pieces are found: the last words of a piece are searched again with the next."""
    overlap = max((p.m for p in found), default=1) - 1
    total, spans, items, tail = 0, [], set(), []
    for part in pieces(raw):
        words = tail + part
        base = total - len(tail)
        for p in found:
            for start, ks in p.search(words):
                spans.append((base + start, base + start + p.m))
                items.update(ks)
        total += len(part)
        tail = words[-overlap:] if overlap else []
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            if b > merged[-1][1]:
                merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return total, merged, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows with words, block by block; the driver holds one block and what Spark prefetches of a partition."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"] or "", r["t"]))
        held += len(r["t"])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


SPANS = "doc_id long, fp long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def search(docs: DataFrame, items: list[tuple[str, str]], window: int) -> tuple[DataFrame, Broadcast]:
    """One pass over docs (doc_id, fp, text) for one block of the benchmark, and the broadcast that it reads."""
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    sent = docs.sparkSession.sparkContext.broadcast((ids, [(number[i], t) for i, t in items]))
    kind = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches):
        names, numbered = sent.value
        found = tables(numbered, window)
        for batch in batches:
            out = {"n_words": [], "spans": [], "items": []}
            for text in batch.column("text"):
                total, spans, hit = find(text.as_buffer().to_pybytes() if text.is_valid else b"", found)
                out["n_words"].append(total)
                out["spans"].append([{"a": a, "b": b} for a, b in spans])
                out["items"].append(sorted(names[k] for k in hit))
            yield pa.record_batch([batch.column("doc_id"), batch.column("fp"), *(pa.array(out[c], kind.field(c).type) for c in ("n_words", "spans", "items"))], schema=kind)

    return docs.mapInArrow(run, SPANS), sent


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, spans (of hit words, merged, end exclusive), items (that occur).

    Null and empty texts have no words and are never hit, whether documents or items. An item id may repeat: its rows
    are one item. A null item id reads as the empty string. Texts of any length are read whole, item or document. Rows
    that are repeated, or share an id, each get their own row. Other columns, whatever their names, are not read. An
    empty table gives no rows; an empty benchmark hits nothing. Items are sent to the tasks in blocks, each dropped
    before the next is read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    seen = []

    def one(block: list[tuple[str, str]]) -> tuple[DataFrame, Broadcast]:
        seen.append(len(block))
        return search(docs, block, window)

    found = in_turn(_blocks(benchmark, item_col, item_text, block_bytes), one, "contamination")
    found, many = search(docs, [], window)[0] if found is None else found, len(seen) > 1
    if not many:
        return found.drop("fp")
    # Rows that repeat id and text have one result, so both together name a document.
    merged = found.groupBy("doc_id", "fp").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = docs.select(F.col("doc_id").alias("d"), F.col("fp").alias("f")).join(merged, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("f") == F.col("fp")))
    return merged.select("doc_id", "n_words", F.expr("""
        aggregate(s, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, x) ->
          case when size(acc) > 0 and x.a <= element_at(acc, -1).b
               then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a as a, greatest(element_at(acc, -1).b, x.b) as b)))
               else concat(acc, array(x)) end)""").alias("spans"), "items")  # fmt: skip


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_decontaminate(spark, sf_dir):
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def reference(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """By brute force: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for d, text in documents:
        words, hit, seen = words_of(text), set(), set()
        for k, t in items:
            its = words_of(t)
            m = min(window, len(its))
            for i in range(len(its) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == its[i : i + m]:
                        hit.update(range(j, j + m))
                        seen.add(str(k))
        out.append((d, len(words), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
h AS MATERIALIZED (
  SELECT doc_id, i, x.m, item_id
  FROM (SELECT doc_id, ms.m, i, array_to_string(w[i : i + ms.m - 1], ' ') AS k
        FROM (SELECT DISTINCT m FROM p) ms, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE i + ms.m - 1 <= len(w)) x
  JOIN p ON p.m = x.m AND p.k = x.k
),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window (see contamination()), with their columns as they are, whatever their names.

    Null and empty texts stay; so does all with an empty benchmark. Repeated rows stay or go together.
    """
    spark = docs.sparkSession

    def hit(block: list[tuple[str, str]], column: str):
        sent = spark.sparkContext.broadcast([(k, t) for k, (_, t) in enumerate(block)])

        def told(batches):
            found = tables(sent.value, window)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(column))
                yield batch, pa.array([bool(t.is_valid and find(t.as_buffer().to_pybytes(), found)[1]) for t in texts], pa.bool_())

        return told, sent

    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:  # rows are filtered where they are read
        told, _ = hit(first, text_col)
        return docs.mapInArrow(lambda batches: (b.filter(pc.invert(h)) for b, h in told(batches)), docs.schema)
    own, fp = fresh(docs, "_id"), fresh(docs, "_fp")
    src = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("f"), F.col(text_col).alias("text"))

    def one(block: list[tuple[str, str]]) -> tuple[DataFrame, Broadcast]:
        told, sent = hit(block, "text")
        return src.mapInArrow(lambda batches: (b.filter(h).select(["i", "f"]) for b, h in told(batches)), src.select("i", "f").schema), sent

    gone = in_turn(chain([first, second], blocks), one, "hit").distinct().select(F.col("i").alias(own), F.col("f").alias(fp))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(fp)), "left_anti")
