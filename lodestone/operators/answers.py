"""Reranking, context budgets and extractive answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import NO_MATCH_MESSAGE, OFFLINE_REFUSAL_MESSAGE, REFUSAL_MESSAGE, Settings
from ..functions.text import normalize, sentences, source_reference, strip, user_prompt, with_sources
from ..functions.tokenizers import alnum_tokens, evidence_tokens
from .evidence import refusal_online, searchable


def rerank(questions: DataFrame, chunks: DataFrame, min_similarity: float = 0.18) -> DataFrame:
    """chunks (query_id, id, title, section, content, similarity) that match, with overlap, rank_score and rank.

    A chunk matches by similarity or by a shared token; ten points for each shared token come before similarity.
    """
    q = questions.select("query_id", evidence_tokens(F.col("question")).alias("q"))
    both = chunks.join(q, "query_id").withColumn("overlap", F.size(F.array_intersect("q", evidence_tokens(searchable(F.col("title"), F.col("section"), F.col("content"))))))
    both = both.filter((F.col("similarity") >= min_similarity) | (F.col("overlap") > 0)).withColumn("rank_score", F.col("overlap") * 10.0 + F.col("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc("similarity"), "id")
    return both.withColumn("rank", F.row_number().over(w)).drop("q")


def context_budget(ranked: DataFrame, max_chars: int = 3600, text_col: str = "content") -> DataFrame:
    """The first chunks of each query while their characters together fit; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("used_chars", F.sum(F.length(text_col)).over(w))
    return out.filter((F.col("used_chars") <= max_chars) | (F.col("rank") == 1))


def best_snippet(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, rank, snippet): of each ranked text (query_id, rank, text) the first sentence that shares most tokens, 500 characters at most."""
    q = questions.select("query_id", F.array_distinct(alnum_tokens(F.col("question"))).alias("q"))
    s = ranked.join(q, "query_id").select("query_id", "rank", "q", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("sentence", normalize(F.col("sentence"))).filter("sentence <> ''")
    shared = F.size(F.array_intersect("q", alnum_tokens(F.col("sentence"))))
    best = s.groupBy("query_id", "rank").agg(F.max_by("sentence", F.struct(shared.alias("n"), (-F.col("pos")).alias("first"))).alias("snippet"))
    return best.select("query_id", "rank", F.substring("snippet", 1, 500).alias("snippet"))


def snippet_budget(snippets: DataFrame, max_chars: int = 512) -> DataFrame:
    """Distinct snippets of each query in order, until their characters reach the limit; the one that reaches it stays."""
    first = snippets.groupBy("query_id", "snippet").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank")
    before = F.coalesce(F.sum(F.length("snippet")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("before", before).filter(F.col("before") < max_chars).drop("before")


def compose(questions: DataFrame, ranked: DataFrame, refusals: DataFrame, max_chars: int = 512) -> DataFrame:
    """(query_id, answer): the best snippets joined, cut at max_chars; without any, the first text's beginning; a fixed sentence if refused."""
    kept = snippet_budget(best_snippet(questions, ranked), max_chars)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "snippet")))
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["snippet"]), "\n\n").alias("joined"))
    head = ranked.groupBy("query_id").agg(F.min_by("text", "rank").alias("head"))
    out = refusals.join(joined, "query_id", "left").join(head, "query_id", "left")
    return out.select("query_id", F.when(F.col("refusal"), OFFLINE_REFUSAL_MESSAGE).otherwise(F.substring(F.coalesce("joined", "head"), 1, max_chars)).alias("answer"))


NOTHING_FOUND = "제공된 모집요강과 FAQ 기준으로는 질문에 대한 근거를 충분히 찾지 못했습니다. 입학처에 직접 문의해 주세요."


def compose_demo(questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, answer): the k best distinct sentences of all chunks (query_id, rank, content, similarity) by twice the shared tokens plus similarity."""
    q = questions.select("query_id", evidence_tokens(F.col("question")).alias("q"))
    s = chunks.join(q, "query_id").select("query_id", "rank", "q", "similarity", F.posexplode(sentences(F.col("content"), "demo")).alias("pos", "sentence"))
    s = s.withColumn("sentence", strip(F.col("sentence"))).filter("sentence <> ''")
    s = s.withColumn("score", F.size(F.array_intersect("q", evidence_tokens(F.col("sentence")))) * 2.0 + F.col("similarity"))
    best = s.groupBy("query_id", "sentence").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), (-F.col("pos")).alias("p"))).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b"))
    best = best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    joined = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("a"))
    whole = F.when(F.col("a").endswith("."), F.col("a")).otherwise(F.concat("a", F.lit("입니다.")))
    return questions.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce(whole, F.lit(NOTHING_FOUND)).alias("answer"))


def context_rows(context: DataFrame) -> DataFrame:
    """(query_id, chunks): the context of each query as an ordered array."""
    c = F.struct("rank", "id", "title", "posted_at", "url", "page", "section", "content", "similarity")
    return context.groupBy("query_id").agg(F.array_sort(F.collect_list(c)).alias("chunks"))


def chat(questions: DataFrame, retrieved: DataFrame, settings: Settings | None = None, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, status, answer, sources, prompt): guard, match, rerank, trim, generate, footer.

    retrieved: (query_id, id, title, section, page, url, posted_at, content, dense_score). generate takes (query_id,
    question, prompt, chunks) and gives (query_id, answer); without it the answer is extracted.
    """
    s = settings or Settings()
    decisions, evidence = refusal_online(questions, retrieved, s)
    matched = rerank(questions, evidence.drop("overlap", "coverage").withColumn("similarity", F.col("dense_score")), s.min_similarity)
    context = context_budget(matched, s.max_context_chars)
    rows = context_rows(context).join(questions.select("query_id", "question"), "query_id").withColumn("prompt", user_prompt(F.col("question"), F.col("chunks")))
    made = generate(rows) if generate else compose_demo(rows.select("query_id", "question"), context.select("query_id", "rank", "content", "similarity"))
    limit = max(1, s.response_source_limit)
    sources = F.transform(F.slice("chunks", 1, limit), lambda c: source_reference(c["title"], c["page"], c["section"], c["content"], c["similarity"], c["url"], c["posted_at"]))
    told = rows.withColumn("sources", sources).join(made, "query_id").select("query_id", with_sources(F.col("answer"), F.col("sources")).alias("made"), "sources", "prompt")
    out = decisions.join(told, "query_id", "left")
    none = F.col("allowed") & F.col("made").isNull()
    return out.select(
        "query_id", F.when(none, "NO_MATCH").otherwise(F.col("status")).alias("status"),
        F.when(~F.col("allowed"), REFUSAL_MESSAGE).when(none, NO_MATCH_MESSAGE).otherwise(F.col("made")).alias("answer"), "sources", "prompt")
