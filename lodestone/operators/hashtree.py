"""What changed in a corpus, by an ordered tree of hashes over ranges of ids. DataFrame functions only.

A leaf is the hash of the documents of LEAF neighbouring ids, a node that of FAN neighbouring nodes below it, up to one
root. Equal roots mean equal corpora; else only what lies below differing nodes is looked at. Leaves are made where
their documents are; no task sees more than a leaf's documents or a node's children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored

LEAF, FAN = 64, 16


def _below(x: Column, n: int) -> Column:
    """floor(x / n), for negative numbers too."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def _told(key: str) -> Column:
    """The hash of rows of a key and a digest, in the order of the key."""
    rows = F.array_sort(F.collect_list(F.struct(key, "digest")))  # LEAF documents or FAN nodes
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r[key].cast("string"), F.lit(":"), r["digest"], F.lit("\n"))), ""), 256).alias("digest")


def digests(docs: DataFrame, parts: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, digest): a hash of the columns in parts, where null is unlike any text."""
    told = F.concat(*[F.when(F.col(c).isNull(), F.lit("\0")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in parts])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(told, 256).alias("digest"))


def tree(rows: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(level, node, n, digest) of (id, digest): level 0 has the leaves, the largest level the root.

    Ids are whole numbers; documents that repeat an id count by their digests, in order. Null ids are not in the tree.
    No rows give no tree.
    """
    level = stored(rows.filter("id is not null").groupBy(_below(F.col("id"), leaf).alias("node")).agg(F.count("*").alias("n"), _told("id")), "tree-leaves")
    out = []
    while True:
        out.append(level.select(F.lit(len(out)).alias("level"), "node", "n", "digest"))
        ends = level.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()  # one row
        if ends["a"] == ends["b"]:
            return reduce(DataFrame.unionByName, out)
        up = F.lit(0).cast("long") if (ends["a"], ends["b"]) == (-1, 0) else _below(F.col("node"), fan)
        level = stored(level.groupBy(up.alias("up")).agg(F.sum("n").alias("n"), _told("node")).withColumnRenamed("up", "node"), "tree-nodes")


def differing(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """(node): the leaves that differ, found from the top down. Trees of other heights differ below their roots in all leaves."""
    tops = [t.agg(F.max("level").alias("m")).first()["m"] for t in (old, new)]
    leaves = lambda t: t.filter("level = 0").select("node", "digest")
    if tops[0] != tops[1]:
        a, b = leaves(old), leaves(new)
        return a.withColumnRenamed("digest", "had").join(b, "node", "full").filter(~F.col("had").eqNullSafe(F.col("digest"))).select("node")
    wanted = None
    for k in range(tops[0] or 0, -1, -1):
        own = [t.filter(F.col("level") == k).select("node", "digest") for t in (old, new)]
        if wanted is not None:
            up = F.lit(0).cast("long") if k == tops[0] - 1 else _below(F.col("node"), fan)
            own = [t.join(wanted.select(F.col("node").alias("up")), up == F.col("up"), "left_semi") for t in own]
        both = own[0].withColumnRenamed("digest", "had").join(own[1], "node", "full")
        wanted = stored(both.filter(~F.col("had").eqNullSafe(F.col("digest"))).select("node"), "differing-nodes")
    return wanted


def changes(old: DataFrame, new: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(id, kind) of documents that were added, changed or deleted between two tables (id, digest) of unique ids."""
    nodes = differing(tree(old, leaf, fan), tree(new, leaf, fan), fan).withColumnRenamed("node", "own")
    a, b = (t.join(nodes, _below(F.col("id"), leaf) == F.col("own"), "left_semi") for t in (old, new))
    kind = F.when(F.col("had").isNull(), "added").when(F.col("digest").isNull(), "deleted").when(F.col("had") != F.col("digest"), "changed")
    return a.withColumnRenamed("digest", "had").join(b, "id", "full").select("id", kind.alias("kind")).filter("kind is not null")
