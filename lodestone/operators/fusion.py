"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up


def rrf(bm25: DataFrame, dense: DataFrame, k: int = 5, rrf_k: int = 60, profile: str = "offline", method: str = "rrf") -> DataFrame:
    """(query_id, id, bm25_score, dense_score, bm25_rank, dense_rank, hybrid_score, hybrid_rank).

    Ties keep the order in which candidates enter: those that BM25 lists by its rank, then the others by theirs.
    """
    if method != "rrf":
        raise ValueError(f"no such fusion: {method}")
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    both = bm25.join(dense, ["query_id", "id"], "full_outer").withColumn("hybrid_score", part("bm25_rank") + part("dense_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid_score", 12)), F.asc_nulls_last("bm25_rank"), F.asc("dense_rank"))
    out = both.withColumn("hybrid_rank", F.row_number().over(w)).filter(F.col("hybrid_rank") <= k)
    if profile == "online":
        out = out.withColumn("hybrid_score", round_half_up(F.col("hybrid_score"), 6))
    return out.select("query_id", "id", "bm25_score", "dense_score", "bm25_rank", "dense_rank", "hybrid_score", "hybrid_rank")
