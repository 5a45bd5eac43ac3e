"""Retrieval metrics by method, and by method and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["method", "subset", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5", "answer_accuracy", "faithfulness", "answer_relevance", "source_accuracy", "hallucination_rate", "context_precision", "date_accuracy", "place_accuracy", "contact_accuracy", "target_accuracy", "table_qa_accuracy", "refusal_accuracy", "avg_latency_ms", "note"]
NOTE = "Retrieval metrics are notice_id-level. Generation/field metrics require human or LLM-as-judge labeling."


def position(ids: Column, gold: Column) -> Column:
    """The 1-based place of gold, null if it isn't there."""
    return F.when(gold != "", F.nullif(F.array_position(ids, gold), F.lit(0).cast("long")))


def hit_at(ids: Column, gold: Column, k: int) -> Column:
    return F.when(position(ids, gold) <= k, 1.0).otherwise(0.0)


def reciprocal_rank(ids: Column, gold: Column) -> Column:
    return F.coalesce(1.0 / position(ids, gold), F.lit(0.0))


def ndcg_at_5(ids: Column, gold: Column) -> Column:
    p = position(ids, gold)
    return F.when(p <= 5, 1.0 / F.log2(p + 1)).otherwise(0.0)


def ir_metrics(rows: DataFrame) -> DataFrame:
    """rows: (method, category, gold_notice_id, retrieved_notice_ids array, refusal, latency_ms).

    One row `all` for each method and one for each category that isn't blank. Recall, MRR and nDCG are over rows with a
    gold id, refusal accuracy over those without, latency over all (null as 0). A mean over nothing is null.
    """
    gold, ids = F.coalesce("gold_notice_id", F.lit("")), F.coalesce("retrieved_notice_ids", F.array().cast("array<string>"))
    known = gold != ""
    per = rows.select(
        "method", F.coalesce("category", F.lit("")).alias("category"),
        *[F.when(known, hit_at(ids, gold, k)).alias(f"h{k}") for k in (1, 3, 5)],
        F.when(known, reciprocal_rank(ids, gold)).alias("rr"), F.when(known, ndcg_at_5(ids, gold)).alias("nd"),
        F.when(~known, F.coalesce(F.col("refusal"), F.lit(False)).cast("double")).alias("rf"), F.coalesce("latency_ms", F.lit(0.0)).cast("double").alias("ms"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    grouped = per.rollup("method", "category").agg(F.grouping_id().alias("g"), mean("h1", "recall_at_1"), mean("h3", "recall_at_3"), mean("h5", "recall_at_5"), mean("rr", "mrr"), mean("nd", "ndcg_at_5"), mean("rf", "refusal_accuracy"), mean("ms", "avg_latency_ms"))
    kept = grouped.filter("g = 1 or (g = 0 and category <> '')")
    return kept.select("method", F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("subset"), "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5", "refusal_accuracy", "avg_latency_ms")


def metric_table(metrics: DataFrame) -> DataFrame:
    """All columns of the report; those that need people or a model to judge are null."""
    have = set(metrics.columns)
    return metrics.select(*[F.col(c) if c in have else F.lit(NOTE if c == "note" else None).cast("string").alias(c) for c in COLUMNS])
