"""Retrieval end to end: chunks, indexes, batches of questions, answers, runs and their comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import Settings
from ..functions.numbers import effective_model
from ..functions.text import or_else, ordered_unique
from ..functions.vectors import with_embedding
from ..operators import answers, dense, evidence, fusion, lexical
from ..operators.chunks import chunk_table
from ..tables import stored

#: Keys of a chunk's metadata that a result carries along. Fixed values.
LAYOUT_KEYS = ["notice_id", "source_image_path", "ocr_engine", "preprocess_profile", "block_type", "bbox", "page", "reading_order", "confidence", "extracted_dates", "extracted_contacts"]


@dataclass
class Index:
    """Chunks with their BM25 index and vectors."""

    chunks: DataFrame
    bm25: lexical.Bm25Index
    vectors: DataFrame
    profile: str
    dim: int

    def write(self, path: str) -> Index:
        """Stores the parts; what is read back starts from files."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.bm25.write(f"{path}/bm25")
        return Index.read(spark, path, self.profile, self.dim)

    @classmethod
    def read(cls, spark, path: str, profile: str = "offline", dim: int = 256) -> Index:
        return cls(spark.read.parquet(f"{path}/chunks"), lexical.Bm25Index.read(spark, f"{path}/bm25", profile), spark.read.parquet(f"{path}/vectors"), profile, dim)


def build(chunks: DataFrame, profile: str = "offline", dim: int = 256, id_col: str = "chunk_id", text_col: str = "text", document_col: str | None = None) -> Index:
    src = stored(chunks.withColumn("id", F.col(id_col)).withColumn("text", F.col(text_col)), "chunks")
    vectors = with_embedding(src.select("id", "text"), "text", profile, dim).select("id", "embedding")
    return Index(src, lexical.build_index(src, "id", "text", profile, document_col), vectors, profile, dim)


def query_vectors(questions: DataFrame, profile: str, dim: int) -> DataFrame:
    return with_embedding(questions.select("query_id", "question"), "question", profile, dim).select("query_id", "embedding")


def hybrid(index: Index, questions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The fused ranking of each question (query_id, question)."""
    s = settings or Settings()
    a = lexical.search(index.bm25, questions, s.bm25_top_k)
    b = dense.search(index.vectors, query_vectors(questions, index.profile, index.dim), s.dense_top_k, index.dim, normalised=index.profile == "offline")
    return fusion.rrf(a, b, s.hybrid_top_k, s.rrf_k, index.profile, s.fusion_method)


def dense_only(index: Index, questions: DataFrame, k: int) -> DataFrame:
    return dense.search(index.vectors, query_vectors(questions, index.profile, index.dim), k, index.dim, normalised=index.profile == "offline")


def with_chunks(ranked: DataFrame, index: Index) -> DataFrame:
    """Rankings joined with their chunks."""
    return ranked.join(index.chunks, "id")


def run(index: Index, questions: DataFrame, method: str, settings: Settings | None = None) -> DataFrame:
    """A result row for each question (query_id, question, category, important, gold_notice_id).

    index.chunks has id, document_id, title, url, posted_at, content_type, section, text, metadata map. Time is not
    taken for each question: they are answered together, and latency_ms is null.
    """
    s = settings or Settings()
    ranked = with_chunks(hybrid(index, questions, s), index).withColumn("rank", F.col("hybrid_rank"))
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    ranked = ranked.withColumn("notice", F.coalesce(meta("notice_id"), meta("gold_notice_id"), F.col("document_id").cast("string")))
    refused = evidence.refusal_offline(questions, ranked.select("query_id", "rank", "text", "dense_score"), s)
    told = answers.compose(questions, ranked.select("query_id", "rank", "text"), refused, s.max_output_tokens)
    payload = F.struct(
        F.col("id").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.col("notice").alias("notice_id"), "title", "url", "posted_at", "content_type", "section", F.substring("text", 1, 300).alias("preview"),
        F.map_entries(F.map_filter("metadata", lambda k, v: k.isin(LAYOUT_KEYS))).alias("layout_metadata"))
    score = F.struct(F.col("id").alias("chunk_id"), "bm25_score", "dense_score", "hybrid_score", "bm25_rank", "dense_rank", "hybrid_rank")
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", payload.alias("p"), score.alias("s")))).alias("r"))
    each = lambda f: F.transform("r", f)
    rows = rows.select("query_id", each(lambda x: x["p"].withField("layout_metadata", F.map_from_entries(x["p"]["layout_metadata"]))).alias("retrieved_chunks"), each(lambda x: x["s"]).alias("retrieval_scores"))
    out = questions.join(rows, "query_id", "left").join(refused.select("query_id", "refusal", "refusal_reason"), "query_id").join(told, "query_id")
    field = lambda name: ordered_unique(F.transform(F.coalesce("retrieved_chunks", F.array().cast(rows.schema["retrieved_chunks"].dataType)), lambda p: p[name]))
    ids = field("notice_id")
    model, important = F.lit("demo-extractive"), F.lit("")
    return out.select(
        F.col("query_id").alias("question_id"), "question", "category", "important", "gold_notice_id", F.lit(method).alias("method"), "answer", "retrieved_chunks", F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("")).alias("top1_notice_id"), ids.alias("retrieved_notice_ids"),
        field("title").alias("source_titles"), field("url").alias("source_urls"), field("posted_at").alias("posted_at"), "retrieval_scores", F.lit(None).cast("double").alias("latency_ms"), "refusal", "refusal_reason", F.lit("mock").alias("generation_provider"),
        effective_model(F.col("important"), model, important).alias("generation_model"), F.lit(s.hybrid_top_k).alias("top_k"))


def compare(indexes: dict[str, Index], questions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The runs of several methods, one below the other."""
    return reduce(DataFrame.unionByName, [run(ix, questions, m, settings) for m, ix in indexes.items()])


def chat(index: Index, questions: DataFrame, settings: Settings | None = None, generate=None) -> DataFrame:
    """Answers from dense retrieval alone, with refusals. index.chunks also has page."""
    s = settings or Settings()
    got = with_chunks(dense_only(index, questions, max(1, s.retrieval_top_k)), index)
    got = got.select("query_id", "id", "title", "section", "page", "url", "posted_at", F.col("text").alias("content"), "dense_score")
    return answers.chat(questions, got, s, generate)


def retrieval_log(ranked: DataFrame, questions: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """Rankings as log rows."""
    s = settings or Settings()
    logged = with_chunks(ranked, index).join(questions.select("query_id", "question"), "query_id")
    return logged.select(
        F.lit(s.index_name).alias("index_name"), F.lit(s.corpus_profile).alias("corpus_profile"), F.lit(s.index_version).alias("index_version"), "question", F.col("id").alias("chunk_id"), "document_id", or_else(F.try_element_at("metadata", F.lit("notice_id"))).alias("notice_id"),
        "bm25_score", "dense_score", "hybrid_score", "bm25_rank", "dense_rank", "hybrid_rank", F.lit(s.hybrid_top_k).alias("top_k"), F.lit(s.rrf_k).alias("rrf_k"), F.lit(s.fusion_method).alias("fusion_method"), F.current_timestamp().alias("created_at"))


def documents_index(documents: DataFrame, settings: Settings | None = None, profile: str = "offline") -> Index:
    """An index of documents (document_id, title, path, url, posted_at, content_type, metadata, text)."""
    s = settings or Settings()
    keep = ["title", "path", "url", "posted_at", "content_type", "metadata"]
    c = chunk_table(documents, "document_id", "text", s.chunk_size, first_name=F.col("title") if profile == "online" else "Document", keep=keep)
    return build(c.withColumn("page", F.lit(None).cast("int")), profile, s.embedding_dim, document_col="document_id")


def reindex(documents: DataFrame, path: str, settings: Settings | None = None, force: bool = False, profile: str = "online") -> tuple[str, Index | None]:
    """(reason, index): builds and stores the index unless the stored metadata say that it is up to date."""
    from ..operators import provenance
    from ..operators.chunks import sections

    s = settings or Settings()
    spark = documents.sparkSession
    sec = documents.select("document_id", "title", "path", "content_type", F.posexplode(sections(F.col("text"), F.col("title"))).alias("section_index", "x")).select("*", F.col("x.section").alias("section"), F.lit(None).cast("int").alias("page"), F.col("x.text").alias("text")).drop("x")
    index = documents_index(documents, s, profile)
    expected = (
        provenance.corpus_hash(sec).crossJoin(documents.agg(F.count("*").cast("int").alias("document_count"))).crossJoin(index.chunks.agg(F.count("*").cast("int").alias("chunk_count")))  # one row each
        .select(F.lit(s.index_name).alias("index_name"), F.lit(s.corpus_profile).alias("corpus_profile"), F.lit(s.index_version).alias("index_version"), "document_count", "chunk_count", "corpus_hash", F.lit(s.embedding_model).alias("embedding_model"), F.lit(s.embedding_dim).alias("embedding_dim"), F.lit(s.chunk_size).alias("chunk_size"), F.lit(s.chunk_overlap).alias("chunk_overlap"), F.lit(s.tokenizer).alias("tokenizer"), F.lit(provenance.retrieval_config_hash(s)).alias("retrieval_config_hash"), F.lit(s.source_data_path).alias("source_data_path"))
    )
    stored, base = f"{path}/index_metadata", f"{path}/{s.index_name}/{s.index_version}"
    from pyspark.errors import AnalysisException

    from ..schemas import schema

    try:
        known = spark.read.schema(schema("index_metadata")).parquet(stored)
        n = Index.read(spark, base, profile, s.embedding_dim)
        counts = documents.limit(1).select(F.lit(s.index_name).alias("index_name"), F.lit(s.index_version).alias("index_version"), F.lit(1).alias("documents")).crossJoin(n.chunks.limit(1).agg(F.count("*").alias("chunks"))).crossJoin(n.vectors.limit(1).agg(F.count("*").alias("embeddings")))  # one row each
    except AnalysisException:
        known = spark.createDataFrame([], schema("index_metadata"))
        counts = spark.createDataFrame([], "index_name string, index_version string, documents int, chunks long, embeddings long")
    decision = provenance.reindex_decision(expected, known, counts, force).first()
    if not decision["reindex_required"]:
        return decision["reason"], Index.read(spark, base, profile, s.embedding_dim)
    index = index.write(base)
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    meta = expected.select(F.lit(last + 1).cast("long").alias("id"), *expected.columns, F.current_timestamp().alias("created_at"))
    meta.coalesce(1).write.mode("append").parquet(stored)
    return decision["reason"], index


def with_settings(settings: Settings, **values) -> Settings:
    return replace(settings, **values)
