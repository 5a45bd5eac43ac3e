"""Whether a question has the evidence to be answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import HARD_CUES, Settings
from ..functions.text import strip
from ..functions.tokenizers import alnum_tokens, guard_tokens


def has_cue(question: Column, cues: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether the question names something that is out of the domain."""
    all_ = [c.strip().lower() for c in [*HARD_CUES, *cues] if c and c.strip()]
    return F.exists(F.array(*map(F.lit, all_)), lambda c: F.contains(F.lower(F.coalesce(question, F.lit(""))), c))


def has_cue_of(question: Column, cue_list: Column) -> Column:
    """As has_cue(), with further cues in a column."""
    every = F.concat(F.array(*map(F.lit, HARD_CUES)), F.coalesce(cue_list, F.array().cast("array<string>")))
    clean = F.filter(F.transform(every, lambda c: F.lower(strip(c))), lambda c: c.isNotNull() & (c != ""))
    return F.exists(clean, lambda c: F.contains(F.lower(F.coalesce(question, F.lit(""))), c))


def searchable(title: Column, section: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(section, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def refusal_online(questions: DataFrame, retrieved: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, evidence).

    questions: (query_id, question); retrieved: (query_id, id, title, section, content, dense_score). decisions has one
    row for each question: status, allowed, top_dense_score, overlap, coverage. evidence has the retrieved rows that
    back an allowed question. Of the retrieved, the best by dense score count, ties by id.
    """
    s = settings or Settings()
    q = questions.select("query_id", "question", guard_tokens(F.col("question")).alias("q"))
    w = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "id")
    top = retrieved.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max(1, s.refusal_evidence_top_k))
    both = top.join(q, "query_id").withColumn("overlap", F.size(F.array_intersect("q", guard_tokens(searchable(F.col("title"), F.col("section"), F.col("content"))))))
    both = both.withColumn("coverage", F.when(F.size("q") == 0, 0.0).otherwise(F.col("overlap") / F.size("q")))
    relevant = (F.col("overlap") >= max(1, s.refusal_min_token_overlap)) & (F.col("coverage") >= s.refusal_min_token_coverage)
    both = both.withColumn("relevant", relevant)
    best = both.groupBy("query_id").agg(F.max("dense_score").alias("top"), F.max(F.struct("coverage", "overlap")).alias("best"), F.max(F.col("relevant").cast("int")).alias("some"))
    d = q.join(best, "query_id", "left")
    status = (
        F.when(F.col("top").isNull(), "NO_RETRIEVAL")
        .when(F.col("top") < s.refusal_min_dense_score, "LOW_DENSE_SCORE")
        .when(F.size("q") == 0, "EMPTY_QUERY_TOKENS")
        .when(has_cue(F.col("question"), s.refusal_cues) & (F.col("best.coverage") < 1.0), "OUT_OF_DOMAIN_CUE")
        .when(F.col("some") == 0, "LOW_LEXICAL_RELEVANCE")
        .otherwise("MATCHED")
    )
    early = F.col("status").isin("NO_RETRIEVAL", "LOW_DENSE_SCORE", "EMPTY_QUERY_TOKENS")
    decisions = d.withColumn("status", status).select(
        "query_id", "question", "status", (F.col("status") == "MATCHED").alias("allowed"), F.coalesce("top", F.lit(0.0)).alias("top_dense_score"),
        F.when(early, 0).otherwise(F.col("best.overlap")).alias("overlap"), F.when(early, 0.0).otherwise(F.col("best.coverage")).alias("coverage"))
    evidence = both.filter("relevant").join(decisions.filter("allowed").select("query_id"), "query_id", "left_semi").drop("q", "question", "relevant", "k")
    return decisions, evidence


def refusal_offline(questions: DataFrame, ranked: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(query_id, refusal, refusal_reason, overlap, coverage). ranked: (query_id, rank, text, dense_score); the first three texts are pooled."""
    s = settings or Settings()
    q = questions.select("query_id", F.array_distinct(alnum_tokens(F.col("question"))).alias("q"))
    pooled = ranked.groupBy("query_id").agg(
        F.flatten(F.collect_list(F.when(F.col("rank") <= 3, F.array_distinct(alnum_tokens(F.col("text")))))).alias("t"),
        F.max(F.coalesce("dense_score", F.lit(0.0))).alias("best"))
    d = q.join(pooled, "query_id", "left").withColumn("overlap", F.size(F.array_intersect("q", F.coalesce("t", F.array().cast("array<string>")))))
    d = d.withColumn("coverage", F.col("overlap") / F.greatest(F.size("q"), F.lit(1)))
    reason = (
        F.when(F.col("best").isNull(), "NO_RETRIEVAL_RESULT")
        .when(F.col("overlap") < s.refusal_min_token_overlap, "LOW_TOKEN_OVERLAP")
        .when((F.col("coverage") < s.refusal_min_token_coverage) & (F.col("best") < s.refusal_min_dense_score), "LOW_EVIDENCE_COVERAGE")
        .otherwise("")
    )
    return d.select("query_id", (reason != "").alias("refusal"), reason.alias("refusal_reason"), "overlap", "coverage")
