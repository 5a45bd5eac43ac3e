"""Exact dedup by deterministic block naming, in DataFrame functions only.

Each normalised text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and get
integers as names; then pairs of adjacent names are sorted and named in turn, until each document has one name. Two
documents of the same number of rounds have the same name if and only if their texts are equal: a name stands for one
string, never for a hash value.

Blocks travel by a 128-bit key, so that the text is shuffled once (each distinct block once per task). A key that
stands for two blocks would break this, so keys are counted, and another seed is taken until each has one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, table

BLOCK = 4096


def normalised(text: Column) -> Column:
    """text with each run of [\\x20\\x09-\\x0D] as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _blocks(text: Column, block: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _keys(block: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a block, neither of which follows from the other: the seed goes in first, and differs."""
    return F.xxhash64(F.lit(2 * seed), block).alias("k1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("k2")


def _name_blocks(blocks: DataFrame, seed: int) -> DataFrame | None:
    """(k1, k2, name) of the distinct blocks; None if two blocks share a key."""
    keyed = blocks.select(*_keys(F.col("block"), seed), "block")
    sorted_ = keyed.distinct().sortWithinPartitions("block")
    names = materialize(sorted_.select("k1", "k2", F.monotonically_increasing_id().alias("name")), "block-names")
    if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        return names
    drop(names)
    return None


def block_names(docs: DataFrame, id_col: str, text: Column, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents as (rid, doc_id, sha), a row for each row of docs, and (rid, level, name): their identities."""
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blocks", _blocks(F.col("text"), block))
    seed = 1
    while (names := _name_blocks(cut.select(F.explode("blocks").alias("block")), seed)) is None:
        seed += 1
    keys = F.transform("blocks", lambda b: F.struct(*_keys(b, seed)))
    rows = materialize(cut.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("sha"), keys.alias("keys")), "block-rows")
    placed = rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    placed = placed.select("rid", "n", "pos", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
    now = materialize(placed.join(names, ["k1", "k2"]).select("rid", "n", "pos", "name"), "named-0")
    drop(names)
    done, level = [], 0
    while True:
        done.append(now.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        left = now.filter("n > 1")
        if left.isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"),
        )
        pair_names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
        pair_names = materialize(pair_names, "pair-names")
        level += 1
        now = materialize(pairs.join(pair_names, ["a", "b"]).select("rid", "n", "pos", "name"), f"named-{level}")
        drop(pair_names)
    return rows.select("rid", "doc_id", "sha"), reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts are equal. The smallest id stays; a null id is larger than all
    others, and of rows with the same id and text (ties, repeated rows) one stays. A text of any length is read whole
    and cut into blocks. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows, names = block_names(docs, id_col, normalised(F.col(text_col)), block)
    known = materialize(rows.join(names, "rid"), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    groups = known.groupBy("level", "name").agg(F.count("*").alias("group_size"), first)
    groups = materialize(groups, "groups")
    return known.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay (see exact_dedup()), with all their columns, whatever their names.

    Of rows that repeat both id and text, one stays; null and empty texts are equal. An empty table stays empty.
    """
    return kept_rows(docs, exact_dedup(docs, id_col, text_col, block).filter("kept").select("doc_id", F.col("text_sha256").alias("sha")), id_col, normalised(F.col(text_col)))


def kept_rows(docs: DataFrame, keep: DataFrame, id_col: str, text: Column) -> DataFrame:
    """docs' rows with an id and text (by its checksum) in keep (doc_id, sha); of rows that repeat both, one stays."""
    sha, keep_id, keep_sha = (fresh(docs, x) for x in ("_sha", "_keep_id", "_keep_sha"))
    keep = materialize(keep.distinct(), "kept").select(F.col("doc_id").alias(keep_id), F.col("sha").alias(keep_sha))
    own = docs.withColumn(sha, F.sha2(text, 256))
    repeated = not own.groupBy(id_col, sha).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    left = own.join(keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)), "left_semi")
    return (left.dropDuplicates([id_col, sha]) if repeated else left).drop(sha)
