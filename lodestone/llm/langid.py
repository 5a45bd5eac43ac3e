"""Language ID by nearest centroids.

A text is a vector of character n-grams (1 to 3, hashed), weighted by log term frequency and idf and normalised. Each
language has several centroids, from spherical k-means over a bounded sample of labelled texts. The nearest centroid
by cosine names the language. A text farther from every centroid than texts of its length are is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Labelled texts for each language, at most; every language is learned.
PER_LANGUAGE = 300
#: Of a sampled text, the model learns from so many characters at most.
SAMPLE_CHARS = 20_000
CENTROIDS = 4
DIM = 1 << 13
#: Rejected: similarity under this share of the lowest similarity but one in a thousand for the text's length.
REJECT_SHARE, REJECT_QUANTILE = 0.6, 0.001
#: Characters handled at once.
SLAB = 1 << 20

_LETTER = np.zeros(0x110000, bool)
for _c in range(0x110000):
    _LETTER[_c] = not 0xD800 <= _c < 0xE000 and chr(_c).isalpha()
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def code_points(text: str) -> np.ndarray:
    """Lower case; each run of anything but letters is one space, and so are both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[c]
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[-1:] &= letter[-1:]
    return np.concatenate([[32], c[keep], [32]]).astype(np.uint64)


def grams(c: np.ndarray, first: int | None = None) -> np.ndarray:
    """Buckets of the n-grams, n from 1 to 3, that begin at the first places (all, if none are named)."""
    first = len(c) if first is None else first
    a = (c + np.uint64(1)) * _K[0]
    two = (a[:-1] ^ (c[1:] * _K[1])) * _K[2]
    three = (two[:-1] ^ (c[2:] * _K[3])) * _K[1]
    shift = np.uint64(40)
    return np.concatenate([((a[:first] * _K[3]) >> shift) % DIM, (two[:first] >> shift) % DIM, (three[:first] >> shift) % DIM]).astype(np.int64)


def counts(texts: list[np.ndarray]) -> np.ndarray:
    """A row of n-gram counts for each text. A long text is counted slab by slab: each n-gram in the slab where it begins."""
    out = np.zeros((len(texts), DIM), np.float32)
    group, size, first = [], 0, 0

    def flush(upto: int) -> None:
        nonlocal group, size, first
        if group:
            n = len(group)
            keys = np.concatenate([g + k * DIM for k, g in enumerate(group)])
            out[first:upto] = np.bincount(keys, minlength=n * DIM).reshape(n, DIM)
        group, size, first = [], 0, upto

    for i, c in enumerate(texts):
        if len(c) > SLAB:
            flush(i)
            for s in range(0, len(c), SLAB):
                out[i] += np.bincount(grams(c[s : s + SLAB + 2], SLAB), minlength=DIM)
            first = i + 1
            continue
        group.append(grams(c))
        size += len(c)
        if size >= SLAB or len(group) >= 64:
            flush(i + 1)
    flush(len(texts))
    return out


def length_class(c: np.ndarray) -> int:
    return int(len(c)).bit_length()


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # (languages * CENTROIDS, DIM), unit rows
    of: np.ndarray  # language of each centroid
    idf: np.ndarray
    floor: np.ndarray  # by length class

    def vectors(self, texts: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(counts(texts)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, similarity, rejected) of each; ("und", 0, True) without a letter, or without a language learned."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for s in range(0, len(texts), 64):
            points = [code_points(t) if t else np.empty(0, np.uint64) for t in texts[s : s + 64]]
            part = [k for k, c in enumerate(points) if (c != 32).any()]
            if not part:
                continue
            cos = self.vectors([points[k] for k in part]) @ self.centroids.T
            best = cos.argmax(1)
            for k, j, x in zip(part, best, cos[np.arange(len(part)), best], strict=True):
                floor = self.floor[min(length_class(points[k]), len(self.floor) - 1)]
                out[s + k] = (self.languages[self.of[j]], float(min(1, max(0, x))), bool(x < floor))
        return out


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; no chance involved."""
    k = min(k, len(v))
    c = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(8):
        near = (v @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                m = v[near == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    rows = sorted((lang, t[:SAMPLE_CHARS]) for lang, t in rows)
    points = [code_points(t) for _, t in rows]
    rows, points = [r for r, c in zip(rows, points, strict=True) if (c != 32).any()], [c for c in points if (c != 32).any()]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(DIM, np.float32), np.zeros(1))
    seen = np.concatenate([(counts(points[s : s + 64]) > 0).sum(0, keepdims=True) for s in range(0, len(points), 64)]).sum(0)
    idf = (np.log((1 + len(points)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(languages, np.zeros((0, DIM), np.float32), np.zeros(0, int), idf, np.zeros(1))
    cents, of = [], []
    label = np.array([languages.index(lang) for lang, _ in rows])
    for j in range(len(languages)):
        c = _clusters(model.vectors([points[i] for i in np.flatnonzero(label == j)]), CENTROIDS)
        cents.append(c)
        of += [j] * len(c)
    model.centroids, model.of = np.concatenate(cents).astype(np.float32), np.array(of)
    # How near texts of each length are to the nearest centroid: whole texts, and stretches of each at every length.
    near: dict[int, list[float]] = {}
    for s in range(0, len(points), 16):
        cuts = [c[o : o + (1 << n)] for c in points[s : s + 16] for n in range(2, length_class(c) + 1) for o in {0, max(0, len(c) // 2 - (1 << n))}]
        cuts = [c for c in cuts if (c != 32).any()]
        for c, x in zip(cuts, (model.vectors(cuts) @ model.centroids.T).max(1), strict=True):
            near.setdefault(length_class(c), []).append(float(x))
    floor, last = np.zeros(33), 0.0
    for n in range(33):
        last = max(last, float(np.quantile(near[n], REJECT_QUANTILE)) * REJECT_SHARE) if n in near and len(near[n]) >= 20 else last
        floor[n] = last
    model.floor = floor
    return model


#: Of a language's texts, so many times PER_LANGUAGE are looked at to find those of the least hashes.
SLACK = 4


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column) -> list[tuple[str, str]]:
    """For each language the PER_LANGUAGE labelled texts of the least hashes of id and text; repeated rows count once.

    Distinct hashes are counted for each language (a sketch), which tells below which hash the wanted ones lie; only
    those few go on. So no task holds a language's rows, and the driver holds a bounded number for each language.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), text_col)
    named = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    seen = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    if not seen:
        return []
    spark = docs.sparkSession
    upto = [(r["lang"], min((1 << 63) - 1, -(1 << 63) + int(min(1.0, SLACK * PER_LANGUAGE / max(1, r["n"])) * (1 << 64)))) for r in seen]
    low = named.select("lang", "h").join(F.broadcast(spark.createDataFrame(upto, "lang string, upto long")), "lang").filter("h <= upto")
    least: dict[str, list[int]] = {}
    for r in low.select("lang", "h").distinct().collect():
        least.setdefault(r["lang"], []).append(r["h"])
    picked = [(lang, x) for lang, xs in least.items() for x in sorted(xs)[:PER_LANGUAGE]]
    rows = named.join(F.broadcast(spark.createDataFrame(picked, "lang string, h long")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()]


OUT = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            got = [g for s in range(0, len(texts), 256) for g in sent.value.predict(texts.slice(s, 256).to_pylist())]
            extra = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *extra], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score, rejected.

    Learns from labelled rows that are not held out: PER_LANGUAGE texts at most of every language, SAMPLE_CHARS
    characters of each. A null text, or one without a letter (Unicode category L), is `und`, score 0, rejected; so is
    any text if there is nothing to learn from. Long texts are read whole. Of centroids that are equally near the first
    counts, in the order of the languages' names. Repeated rows and rows that share an id each get their row; one
    without an id is not held out. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    model = fit(sample(docs, id_col, text_col, lang_col, ~held_out(id_col)))
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that language ID doesn't reject (see language_id()), with all their columns as they are, whatever their names.

    Null texts and texts without a letter go. With nothing to learn from, all rows stay. Repeated rows are judged
    alike. An empty table stays empty.
    """
    model = fit(sample(docs, id_col, text_col, lang_col, ~held_out(id_col)))
    if not model.languages:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            got = [g for s in range(0, len(texts), 256) for g in sent.value.predict(texts.slice(s, 256).to_pylist())]
            yield batch.filter(pa.array([not rejected for _, _, rejected in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
