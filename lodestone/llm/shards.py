"""Sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Rows are numbered globally by (doc_id, text checksum, size), without gaps. A keyed permutation of these numbers gives
the shuffled place; place mod shards is the shard and place div shards the slot. Each row's shard and slot follow from
its number, the number of rows and the key alone, and the permutation can be inverted. Law: rows.

The permutation: numbers below n are split as (x div b, x mod b) with a * b >= n, a and b near the root of n. Four
rounds add a keyed function of one half to the other. A result of n or more is permuted again (cycle walking); fewer
than a of the a * b values are out of range, so this is rare.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 16
KEY = 20_240_601
ROUNDS = 4
M = 2**31 - 1
#: For the ring of shared multipliers; both below 2^31, so that products stay below 2^62.
A1, A2 = 1_597_334_677, 1_103_515_245
#: Steps of a walk. Any walk of a table under WALK^2 rows is shorter; beyond, one this long has odds under WALK^-WALK.
WALK = 64


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    out, x = [], key % M
    for i in range(rounds):
        x = (x * A2 + 12_345 + i) % M
        out.append(x)
    return out


def halves(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, and fewer than b values to spare."""
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return max(1, -(-n // b)), b


def mix(x, k: int):
    """The round function of ints below 2^31; plain ints work as columns do."""
    y = (x * A1 + k) % M
    y = (y * A2 + k) % M if isinstance(y, int) else (y * F.lit(A2) + F.lit(k)) % F.lit(M)
    return y


def permute_int(x: int, n: int, key: int = KEY) -> int:
    """Where row number x of n goes; the same as permuted(), for a reader that computes one place."""
    a, b = halves(n)
    while True:
        hi, lo = divmod(x, b)
        for i, k in enumerate(round_keys(key)):
            if i % 2 == 0:
                hi = (hi + mix(lo, k)) % a
            else:
                lo = (lo + mix(hi, k)) % b
        x = hi * b + lo
        if x < n:
            return x


def permuted(x: Column, n: int, key: int = KEY) -> Column:
    """permute_int() of a column of longs below n."""
    a, b = halves(n)
    keys = round_keys(key)

    def step(i: int, k: int):
        if i % 2 == 0:
            return lambda s: F.struct(((s.hi + mix(s.lo, k)) % F.lit(a)).alias("hi"), s.lo.alias("lo"))
        return lambda s: F.struct(s.hi.alias("hi"), ((s.lo + mix(s.hi, k)) % F.lit(b)).alias("lo"))

    def once(v: Column) -> Column:
        h = F.struct(F.call_function("div", v, F.lit(b)).alias("hi"), F.pmod(v, F.lit(b)).cast("long").alias("lo"))
        state = F.array(h)
        for i, k in enumerate(keys):
            state = F.transform(state, step(i, k))
        return F.element_at(F.transform(state, lambda s: s.hi * F.lit(b) + s.lo), 1)

    out = once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), out, lambda v, _: F.when(v < F.lit(n), v).otherwise(once(v)))
    return F.when(out < F.lit(n), out).otherwise(walked)


def numbered(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """df as a written table with `row`: its place, from 0 and without gaps, by order; rows that tie are in any order.

    Only counts of partitions come together. The scan's own row ids come last in the range keys, so that many rows
    of one key are dealt over many partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(n, *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    at = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "numbered")
    at = at.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = at.groupBy("part").count().collect()  # one row for each partition: their number is bounded
    starts, total = [0] * (max([r["part"] for r in counts], default=0) + 1), 0
    for r in sorted(counts, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["count"]
    out = at.withColumn("row", F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), (F.col("part") + 1).cast("int")) + F.col("nth"))
    out = out.drop("at", "part", "nth")
    out._rows = total  # type: ignore[attr-defined]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as none: size 1, checksum 0. Null ids come first in the numbering. Rows that tie in id,
    checksum and size are interchangeable: which of them has which of their places isn't fixed, their places are.
    Repeated rows each get a place. Long texts count whole. Other columns, whatever their names, are not read. An empty
    table gives no rows. A walk of more than WALK steps in the permutation, which has odds under 2^-WALK, is an error.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = numbered(sized, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    p = placed.withColumn("place", permuted(F.col("row"), placed._rows, key))
    p = p.withColumn("place", F.when(F.col("place") < placed._rows, F.col("place")).otherwise(F.raise_error(F.lit("the walk is too long: take another key")).cast("long")))
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_feistel_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


def _sql() -> str:
    k = round_keys(KEY)
    f = lambda x, key: f"((({x}) * {A1} + {key}) % {M} * {A2} + {key}) % {M}"

    def rounds(src: str, keep: str) -> str:
        """A query of `place` for column x of src."""
        q = f"SELECT {keep}, n, a, b, x // b AS hi, x % b AS lo FROM {src}"
        for i, key in enumerate(k):
            new = f"(hi + {f('lo', key)}) % a AS hi, lo" if i % 2 == 0 else f"hi, (lo + {f('hi', key)}) % b AS lo"
            q = f"SELECT {keep}, n, a, b, {new} FROM ({q})"
        return f"SELECT {keep}, n, a, b, hi * b + lo AS x FROM ({q})"

    return f"""
WITH RECURSIVE tbl AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), sized AS MATERIALIZED (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, byte: xor(c >> 8, t[1 + (xor(c, byte) & 255)])), 4294967295)::BIGINT AS text_crc32
  FROM documents, tbl
), counted AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sized
), cut AS (
  SELECT *, greatest(1, (n + b - 1) // b) AS a FROM (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS b FROM counted)
), walk AS (
  {rounds("cut", "doc_id, size, text_crc32")}
  UNION ALL
  {rounds("(SELECT * FROM walk WHERE x >= n)", "doc_id, size, text_crc32")}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, (x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM walk WHERE x < n
"""


SQL = _sql()
