"""The stored tables: namespaces, joins of documents, chunks and vectors, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("index_name", "index_version")


def namespace(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns have the given values; a null or blank value asks nothing. On partition columns this prunes files."""
    for c, v in keys.items():
        if v is not None and not (isinstance(v, str) and not v.strip()):
            df = df.filter(F.col(c) == v)
    return df


def bucketed(df: DataFrame, name: str, by: str, buckets: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df as a table of the warehouse, dealt to buckets by a column and to folders by keys, and sorted within buckets.

    Tables of as many buckets are joined on that column without moving rows, and a namespace is read from its own
    folders. name must be new.
    """
    dealt = df.repartition(buckets, by)
    (dealt.write.partitionBy(*keys) if keys else dealt.write).bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def documented_chunks(chunks: DataFrame, documents: DataFrame, index_name: str | None = None, index_version: str | None = None) -> DataFrame:
    """chunks with their documents' title, notice_id, url and posted_at, of one namespace."""
    ns = {"index_name": index_name, "index_version": index_version}
    d = namespace(documents, **ns).select(F.col("id").alias("document_id"), "title", "notice_id", "url", "posted_at")
    return namespace(chunks, **ns).join(d, "document_id")


def embedded_chunks(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, index_name: str | None = None, index_version: str | None = None, model: str | None = None, dim: int | None = None) -> DataFrame:
    """documented_chunks() with the vector of one model and length."""
    e = namespace(embeddings, index_name=index_name, index_version=index_version, embedding_model=model, embedding_dim=dim).select("chunk_id", "embedding")
    return documented_chunks(chunks, documents, index_name, index_version).join(e, F.col("id") == F.col("chunk_id")).drop("chunk_id")


def has_knowledge_base(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, index_name: str, index_version: str) -> bool:
    """Whether all three tables have a row in the namespace."""
    return all(not namespace(t, index_name=index_name, index_version=index_version).isEmpty() for t in (documents, chunks, embeddings))


def usage_totals(chat_logs: DataFrame) -> DataFrame:
    """Answers, tokens and cost for each provider and model."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return chat_logs.groupBy("provider", "model").agg(F.count("*").alias("answers"), total("input_tokens"), total("output_tokens"), total("total_tokens"), F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 9).alias("estimated_cost_usd"))
