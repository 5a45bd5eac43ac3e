"""A vector index: cells around clustered centroids, searched exactly by bounds on angles.

Every vector lies in the cell of its nearest centroid, with the angle between the two. Angles obey the triangle
inequality, so a vector's angle to a query is at least the difference between their angles to the centroid. With a score
that k vectors are known to reach, whole cells and, in cells that are read, rings of vectors are left out, and the
answer is still that of a search of all vectors. How much can be left out is a matter of the vectors: near-copies and
clusters are found in few cells, vectors without any structure in all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import in_turn, stored
from .dense import CELLS, Nearest, _blocks, _matrix
from .lexical import top_k

#: Vectors that centroids are fitted on at most; cells at most; rounds of fitting. Every vector is indexed.
SAMPLE, MOST, ROUNDS = 20_000, 1024, 8
#: Slack of angles (radians), for rounding.
SLACK = 1e-7


@dataclass
class CellIndex:
    """vectors (cell, angle, id, embedding), unit vectors sorted by cell and angle within their files; centroids; cells: (cell, n, near, far), a row for each."""

    vectors: DataFrame
    centroids: np.ndarray
    cells: DataFrame
    dim: int


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, by clustering on the sphere; the first ones are spread over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def units(column: pa.Array, dim: int) -> np.ndarray:
    """A unit vector for each row; zeros for a null, a zero vector and another length."""
    v, ok = _matrix(column, dim)
    out = np.zeros((len(column), dim))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    out[ok] = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return out


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def build(vectors: DataFrame, dim: int | None = None, cells: int | None = None, id_col: str = "id", sample: int = SAMPLE) -> CellIndex:
    """The index of (id, embedding), ids not null. Vectors without a direction (null, zero, of another length) are in cell -1.

    Centroids come from `sample` vectors at most, those of the smallest hashes, so the driver's part is bounded.
    """
    src = vectors.select(F.col(id_col).alias("id"), "embedding")
    if dim is None:
        first = src.select(F.size("embedding").alias("n")).filter("n > 0").first()
        dim = first["n"] if first else 1
    n = src.count()
    share = min(1.0, 2 * sample / max(1, n))
    few = src.filter(F.size("embedding") == dim).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).filter(F.col("h") <= int(share * (1 << 30))).orderBy("h").limit(sample).select("embedding").collect()
    taken = np.array([r["embedding"] for r in few], np.float64).reshape(-1, dim)
    taken = taken[np.linalg.norm(taken, axis=1) > 0]
    taken /= np.linalg.norm(taken, axis=1, keepdims=True)
    cells = min(cells or max(1, int(n**0.5) // 2), MOST, max(1, len(taken)))
    centroids = fitted(taken, cells) if len(taken) else np.zeros((1, dim))
    sent = src.sparkSession.sparkContext.broadcast(centroids)
    id_arrow = to_arrow_type(src.schema["id"].dataType)

    def run(batches):
        c = sent.value
        for whole in batches:
            step = max(1, CELLS // max(len(c), dim))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = units(batch.column(1), dim)
                s = v @ c.T
                own = np.argmax(s, axis=1)
                angle = angles(s[np.arange(len(v)), own])
                cell = np.where(np.any(v != 0, axis=1), own, -1).astype(np.int32)
                embedding = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), batch.column(0).cast(id_arrow), embedding], ["cell", "angle", "id", "embedding"])

    placed = src.mapInArrow(run, f"cell int, angle double, id {src.schema['id'].dataType.simpleString()}, embedding array<double>")
    held = stored(placed.sortWithinPartitions("cell", "angle"), "cells")
    found = stored(held.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")), "cell-bounds")
    return CellIndex(held, centroids, found, dim)


def cell_bounds(known: list, centroids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of each query to each known cell's centroid, the smallest angle that a vector of the cell may have to it)."""
    own = angles(q @ centroids[[r["cell"] for r in known]].T)
    near, far = np.array([r["near"] for r in known]), np.array([r["far"] for r in known])
    return own, np.maximum(0, np.maximum(own - far, near - own)) - SLACK


def search(index: CellIndex, queries: DataFrame, k: int = 50) -> tuple[DataFrame, list[dict]]:
    """((query_id, id, dense_score, dense_rank), a report): the k vectors of largest cosine for each query, ties by id, as dense.search().

    The report has queries, cells (of all queries), cells_read and probed for each block of queries.
    """
    spark, dim = index.vectors.sparkSession, index.dim
    known = sorted(index.cells.filter("cell >= 0").collect(), key=lambda r: r["cell"])  # MOST at most
    whole = {r["cell"]: r["n"] for r in index.cells.collect()}
    q_type, id_type = queries.schema["query_id"].dataType, index.vectors.schema["id"].dataType
    q_arrow, id_arrow = to_arrow_type(q_type), to_arrow_type(id_type)
    out = f"query_id {q_type.simpleString()}, id {id_type.simpleString()}, score double"
    report: list[dict] = []

    def scan(ids: list, q: np.ndarray, ways: np.ndarray, wanted: np.ndarray, floor: np.ndarray) -> tuple:
        """The best of each query among the cells it wants; floor: the score it needs. ways: angles to centroids."""
        place = {r["cell"]: j for j, r in enumerate(known)}
        sent = spark.sparkContext.broadcast((ids, q, ways, wanted, floor))
        cells = [r["cell"] for r, some in zip(known, wanted.any(0), strict=True) if some] + [-1]

        def run(batches):
            ids, q, ways, wanted, floor = sent.value
            held = Nearest(len(ids), k)
            most = angles(floor) + SLACK
            for batch in batches:
                cell = batch.column(0).to_numpy()
                edge = np.flatnonzero(np.diff(cell, prepend=-2, append=-2))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    c = int(cell[a])
                    asked = np.arange(len(ids)) if c < 0 else np.flatnonzero(wanted[:, place[c]])
                    if not len(asked):
                        continue
                    step = max(1, CELLS // len(asked))
                    for at in range(a, b, step):
                        part = batch.slice(at, min(step, b - at))
                        if c >= 0:  # the ring that some query can reach
                            own, to = part.column(1).to_numpy(), ways[asked, place[c]]
                            lo, hi = (to - most[asked]).min(), (to + most[asked]).max()
                            part = part.slice(int(np.searchsorted(own, lo)), int(np.searchsorted(own, hi, "right") - np.searchsorted(own, lo)))
                        if part.num_rows:
                            held.add(q[asked] @ units(part.column(3), dim).T, part.column(2), asked)
            best = held.best()
            if best is not None:
                yield from best.select([0, 2, 3]).set_column(0, "query_id", pa.array(ids, q_arrow).take(best.column("q").combine_chunks())).cast(pa.schema([("query_id", q_arrow), ("id", id_arrow), ("score", pa.float64())])).to_batches()

        return index.vectors.filter(F.col("cell").isin(cells)).mapInArrow(run, out), sent

    def one(block: list) -> tuple:
        ids = [x for x, _ in block]
        q = units(pa.array([v for _, v in block], pa.list_(pa.float64())), dim)
        if not known:
            return scan(ids, q, np.zeros((len(q), 0)), np.zeros((len(q), 0), bool), np.full(len(q), -1.0))
        ways, least = cell_bounds(known, index.centroids, q)
        order = np.argsort(least, axis=1, kind="stable")
        sizes = np.array([whole[r["cell"]] for r in known])
        first = np.zeros(ways.shape, bool)
        for j in range(len(q)):  # the nearest cells that hold k vectors
            first[j, order[j, : int(np.searchsorted(np.cumsum(sizes[order[j]]), k)) + 1]] = True
        probe, sent = scan(ids, q, ways, first, np.full(len(q), -1.0))
        names = {x: j for j, x in enumerate(ids)}
        floor = np.full(len(q), -1.0)
        reached = top_k(probe, k, rank="r").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
        for r in reached.filter(F.col("n") == k).collect():  # a row for each query of the block
            floor[names[r["query_id"]]] = r["s"] - 1e-8
        sent.destroy()
        wanted = (np.cos(np.maximum(0, least)) >= floor[:, None]) | ~np.any(q != 0, axis=1)[:, None]
        report.append({"queries": len(q), "cells": int(wanted.size), "cells_read": int(wanted.sum()), "probed": int(first.sum())})
        return scan(ids, q, ways, wanted, floor)

    found = in_turn(_blocks(queries, dim, k), one, "nearest-in-cells")
    found = spark.createDataFrame([], out) if found is None else found
    return top_k(found, k, rank="dense_rank").select("query_id", "id", F.col("score").alias("dense_score"), "dense_rank"), report
