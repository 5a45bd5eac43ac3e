"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: Edges that one task draws together by itself, at most.
FEW = 200_000


def _ends(edges: DataFrame) -> DataFrame:
    """(v, to): for each node of FEW edges at most, the smallest that it reaches; in one task, which holds these edges."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, to = number[: len(a)], number[len(a) :], np.arange(len(nodes))
        while True:
            least, new = np.minimum(to[i], to[j]), to.copy()
            np.minimum.at(new, to[i], least)
            np.minimum.at(new, to[j], least)
            new = new[new]
            if (new == to).all():
                break
            to = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], ["v", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, to long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each node of edges (a, b), the smallest node that it reaches.

    Each round, nodes take the least of their neighbours, follow it one step further (pointer jumping), and are drawn
    together: edges between those that have one label go. So edges dwindle from round to round, and rounds grow with
    the logarithm of a chain's length. Once FEW are left, one task ends it. Labels and edges stay in tables.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = materialize(edges.filter("a <> b").select(low, high).distinct(), "edges")
    nodes = now.select(F.col("a").alias("v")).unionByName(now.select(F.col("b").alias("v"))).distinct()
    told = materialize(nodes.select("v", F.col("v").alias("c")), "labels")
    while left := now.count():
        if left <= FEW:
            ends = materialize(_ends(now), "ends")
            new = materialize(told.join(ends.select(F.col("v").alias("c"), "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels")
            drop(now, told, ends)
            return new.select("v", "c")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "least")
        jump = materialize(least.join(least.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("v", F.least("c", "to").alias("to")), "jump")
        new = materialize(told.join(jump.select(F.col("v").alias("c"), "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels")
        drawn = now.join(jump.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        drawn = materialize(drawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(now, told, least, jump)
        now, told = drawn, new
    return told.select("v", "c")
