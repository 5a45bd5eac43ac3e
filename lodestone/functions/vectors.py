"""Hashes, hashed embeddings and similarities."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokenizers import alnum_tokens, evidence_tokens


def sha256_parts(parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a zero character."""
    return F.sha2(F.concat(F.array_join(parts, "\0"), F.when(F.size(parts) > 0, F.lit("\0")).otherwise("")), 256)


def sha256_of(parts: list[str], each: str = "\0") -> str:
    return hashlib.sha256("".join(p + each for p in parts).encode()).hexdigest()


def java_hash(token: Column) -> Column:
    """The 32-bit polynomial hash with factor 31 of a token's characters (below U+10000), signed."""
    h = F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def bucket_and_sign(token: Column, profile: str, dim: int) -> tuple[Column, Column]:
    if profile == "online":
        return F.pmod(java_hash(token), F.lit(dim)), F.lit(1.0)
    digest = F.sha2(token, 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    odd = F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2
    return F.pmod(number, F.lit(dim)), F.when(odd == 0, 1.0).otherwise(-1.0)


def _place(token: str, profile: str, dim: int) -> tuple[int, float]:
    """bucket_and_sign() of one token."""
    if profile == "online":
        h = 0
        for c in token:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return (h - (h >> 31 << 32)) % dim, 1.0
    d = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] % 2 == 0 else -1.0


def sparse_embedding(df: DataFrame, id_col: str, text_col: str, profile: str = "offline", dim: int = 256) -> DataFrame:
    """(id, bucket, weight): unit vectors of hashed tokens, without zeros. Texts without tokens have no rows.

    Online: distinct tokens, each adds 1. Offline: all tokens, each adds 1 or -1. A worker hashes each distinct token of a
    batch once and adds up each row; rows are dealt by id, once, for ids that several rows have.
    """
    tokens = evidence_tokens if profile == "online" else alnum_tokens
    t = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().dictionary_encode()
            placed = [_place(w, profile, dim) for w in flat.dictionary.to_pylist()]
            if not placed:
                continue
            b, s = np.array([p[0] for p in placed], np.int64), np.array([p[1] for p in placed])
            at = flat.indices.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            v = np.bincount(row * dim + b[at], weights=s[at])
            cells = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cells // dim)), pa.array(cells % dim), pa.array(v[cells])], ["id", "bucket", "w"])

    kind = t.select("id", F.lit(0).cast("long").alias("bucket"), F.lit(0.0).alias("w")).schema
    w = t.mapInArrow(run, kind).repartition("id").groupBy("id", "bucket").agg(F.sum("w").alias("w")).filter("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "bucket", (F.col("w") / norm).alias("weight"))


def with_embedding(df: DataFrame, text_col: str = "text", profile: str = "offline", dim: int = 256, name: str = "embedding") -> DataFrame:
    """df with the unit vector of its text's hashed tokens (zeros if it has none), in one pass and without a shuffle.

    Tokens come from the JVM; a worker hashes each distinct one once and adds rows up as arrays.
    """
    tokens = evidence_tokens if profile == "online" else alnum_tokens
    src = df.withColumn("_tokens", tokens(F.col(text_col)))
    kind = df.withColumn(name, F.lit(None).cast("array<double>")).schema

    def run(batches):
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_tokens"))
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            for w in words:
                if w not in known:
                    known[w] = _place(w, profile, dim)
            b = np.array([known[w][0] for w in words], np.int64) if words else np.empty(0, np.int64)
            s = np.array([known[w][1] for w in words]) if words else np.empty(0)
            at = flat.indices.to_numpy()
            n = batch.num_rows
            row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
            v = np.bincount(row * dim + b[at], weights=s[at], minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=v, where=norm > 0)
            if profile == "online":
                v = v.astype(np.float32).astype(np.float64)
            if len(known) > 500_000:
                known = {}
            arr = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64()))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kind.names[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, arr], kind.names)

    return src.mapInArrow(run, kind)


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(_product(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays; products in the arrays' type, sums in double. 0 for unequal lengths, empty arrays and zero vectors. Norms that are known need not be computed for each pair."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    whole = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(whole, _product(a, b) / norms).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """Sum of products up to the shorter array's end; 0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    xs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda p, q: (p * q).cast("double"))
    return F.when(n > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
