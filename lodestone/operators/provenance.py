"""Hashes of corpora and settings, and whether an index must be built again."""

from __future__ import annotations

import hashlib
import pickle
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import Settings
from ..functions import sha
from ..functions.vectors import sha256_of, sha256_parts
from ..tables import dropped, stored


def retrieval_config_hash(s: Settings, profile: str = "online") -> str:
    if profile == "online":
        return sha256_of([
            f"retrievalTopK={s.retrieval_top_k}", f"hybridTopK={s.hybrid_top_k}", f"bm25TopK={s.bm25_top_k}", f"denseTopK={s.dense_top_k}", f"rrfK={s.rrf_k}", f"fusionMethod={s.fusion_method}",
            f"minSimilarity={s.min_similarity}", f"responseSourceLimit={s.response_source_limit}", f"refusalMinDenseScore={s.refusal_min_dense_score}", f"refusalMinTokenOverlap={s.refusal_min_token_overlap}",
            f"refusalMinTokenCoverage={s.refusal_min_token_coverage}", f"refusalEvidenceTopK={s.refusal_evidence_top_k}", f"refusalOutOfDomainCues={','.join(s.refusal_cues)}"])
    parts = [f"hybridTopK={s.hybrid_top_k}", f"bm25TopK={s.bm25_top_k}", f"denseTopK={s.dense_top_k}", f"rrfK={s.rrf_k}", f"fusionMethod={s.fusion_method}", f"minSimilarity={s.min_similarity}", f"refusalMinDenseScore={s.refusal_min_dense_score}", f"refusalMinTokenOverlap={s.refusal_min_token_overlap}", f"refusalMinTokenCoverage={s.refusal_min_token_coverage:.2f}", f"refusalEvidenceTopK={s.refusal_evidence_top_k}"]
    return sha256_of(["|".join(parts)], "")


def config_hash(settings: Settings | None = None, **own: Column) -> Column:
    """retrieval_config_hash() of the online profile where columns give some of the settings, by their names in the hash."""
    s = settings or Settings()
    # Names and order.
    parts = {
        "retrievalTopK": s.retrieval_top_k, "hybridTopK": s.hybrid_top_k, "bm25TopK": s.bm25_top_k, "denseTopK": s.dense_top_k, "rrfK": s.rrf_k, "fusionMethod": s.fusion_method, "minSimilarity": s.min_similarity, "responseSourceLimit": s.response_source_limit,
        "refusalMinDenseScore": s.refusal_min_dense_score, "refusalMinTokenOverlap": s.refusal_min_token_overlap, "refusalMinTokenCoverage": s.refusal_min_token_coverage, "refusalEvidenceTopK": s.refusal_evidence_top_k, "refusalOutOfDomainCues": ",".join(s.refusal_cues)}
    if unknown := set(own) - set(parts):
        raise ValueError(f"no such settings: {sorted(unknown)}")
    return sha256_parts(F.array(*[F.concat(F.lit(f"{k}="), own.get(k, F.lit(str(v)))) for k, v in parts.items()]))


def document_hashes(sections: DataFrame) -> DataFrame:
    """(document_id, sha) of (document_id, title, path, content_type, section_index, section, page, text)."""
    parts = F.array_sort(F.collect_list(F.struct("section_index", F.array("section", F.coalesce(F.col("page").cast("string"), F.lit("null")), "text").alias("p"))))
    head = F.array(F.first("title"), F.first("path"), F.first("content_type"))
    return sections.groupBy("document_id").agg(sha256_parts(F.concat(head, F.flatten(F.transform(parts, lambda x: x["p"])))).alias("sha"))


#: Bytes of text that one task hashes at most, as far as keys let ranges be cut evenly.
RANGE_BYTES = 128 << 20


def _streamed(rows: DataFrame, order: list[str], head: list[str], parts: list[str], name: str) -> DataFrame:
    """One row: SHA-256 of the parts of all rows in order, each with a zero character behind it; where order[0] changes, the head comes first. Nulls are left out.

    Rows are dealt by range and stored. One task after the other takes the next range, goes on from the hash's state and
    hands it on (some 100 bytes), so a task reads its range only; the time grows with the rows. Without OpenSSL's functions
    there is one range. hashtree.tree() has no such chain.
    """
    named = [*order, *(f"_{k}" for k in range(len(head) + len(parts)))]
    texts = rows.select(*order, *(F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate([*head, *parts])))
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in named[len(order) :]]
    n = (texts.agg(F.sum(reduce(Column.__add__, sizes))).first()[0] or 0) // RANGE_BYTES + 1 if sha.can_hand_on() else 1
    kept = stored(texts.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "hashed", ("_range",)) if n > 1 else None

    def step(state: bytes | None, last):
        def run(batches):
            hashed, before = sha.Sha256(state), last
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                found = []
                for k, own in enumerate(columns[0]):
                    begin = len(order) if (own,) != before else len(order) + len(head)
                    before = (own,)
                    found += [c[k] for c in columns[begin:] if c[k] is not None]
                hashed.update("".join(f"{t}\0" for t in found).encode())
            yield pa.RecordBatch.from_pydict({"state": [hashed.state()], "last": [pickle.dumps(before)], "digest": [hashed.hexdigest()]})

        return run

    state, last, digest = None, None, hashlib.sha256().hexdigest()
    for k in range(n):
        own = texts.repartition(1) if kept is None else kept.filter(F.col("_range") == k).select(*named).coalesce(1)
        told = own.sortWithinPartitions(*order).mapInArrow(step(state, last), "state binary, last binary, digest string").first()
        if told is not None:
            state, last, digest = bytes(told["state"]), pickle.loads(told["last"]), told["digest"]
    if kept is not None:
        dropped(kept)
    return rows.sparkSession.createDataFrame([(digest,)], f"`{name}` string")


def corpus_hash(sections: DataFrame, order: str = "document_id") -> DataFrame:
    """corpus_hash: SHA-256 of all parts of all documents in order, each with a zero character behind it.

    This is one hash over the text of the whole corpus in order, as the contract of stored metadata has it, so its ranges
    are hashed one after the other, in a time that grows with the corpus. corpus_digest() has no such chain.
    """
    rows = sections.withColumn("_page", F.coalesce(F.col("page").cast("string"), F.lit("null")))
    return _streamed(rows, [order, "section_index"], ["title", "path", "content_type"], ["section", "_page", "text"], "corpus_hash")


def corpus_digest(sections: DataFrame) -> DataFrame:
    """corpus_digest: a digest of the set of documents at any size, by sums of their hashes; no task sees more than its rows."""
    h = document_hashes(sections).select("document_id", F.xxhash64("document_id", "sha").alias("a"), F.xxhash64("sha", "document_id", F.lit(7)).alias("b"))
    low = lambda c: F.sum(F.pmod(F.col(c), F.lit(1 << 40)))
    return h.agg(F.count("*").alias("n"), low("a").alias("a"), low("b").alias("b")).select(F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("corpus_digest"))


def ordered_hash(rows: DataFrame, order: str, parts: list[str], name: str = "hash") -> DataFrame:
    """SHA-256 of the parts of all rows in order; its ranges are hashed one after the other."""
    return _streamed(rows, [order], [], parts, name)


def latest(metadata: DataFrame, keys: list[str], by: str = "id") -> DataFrame:
    """The row of the largest `by` for each key."""
    rest = F.struct(*metadata.columns)
    return metadata.groupBy(*keys).agg(F.max_by(rest, by).alias("r")).select("r.*")


#: (column, what a difference is called), in the order in which they are looked at. Fixed values.
MISMATCHES = [("index_name", "INDEX_NAME_CHANGED"), ("index_version", "INDEX_VERSION_CHANGED"), ("document_count", "DOCUMENT_COUNT_CHANGED"), ("chunk_count", "CHUNK_COUNT_CHANGED"), ("corpus_hash", "CORPUS_HASH_CHANGED"), ("embedding_model", "EMBEDDING_MODEL_CHANGED"), ("embedding_dim", "EMBEDDING_DIM_CHANGED"), ("chunk_size", "CHUNK_SIZE_CHANGED"), ("chunk_overlap", "CHUNK_OVERLAP_CHANGED"), ("tokenizer", "TOKENIZER_CHANGED"), ("retrieval_config_hash", "RETRIEVAL_CONFIG_CHANGED"), ("source_data_path", "SOURCE_DATA_PATH_CHANGED")]


def reindex_decision(expected: DataFrame, stored: DataFrame, knowledge_base: DataFrame, force: bool = False) -> DataFrame:
    """(index_name, index_version, reindex_required, reason).

    expected: a row for each index, with the columns of MISMATCHES; stored: metadata rows with an id, of which the
    latest counts; knowledge_base: (index_name, index_version, documents, chunks, embeddings).
    """
    keys = ["index_name", "index_version"]
    old = latest(stored, keys)
    old = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c, _ in MISMATCHES], F.lit(True).alias("known"))
    d = expected.join(old, keys, "left").join(knowledge_base, keys, "left")
    full = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    reason = F.when(F.lit(force), "FORCE_REINDEX").when(F.col("known").isNull(), "METADATA_MISSING")
    reason = reason.when(~(full("documents") & full("chunks") & full("embeddings")), "KNOWLEDGE_BASE_EMPTY")
    for c, name in MISMATCHES:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), name)
    reason = reason.otherwise("INDEX_UP_TO_DATE")
    return d.select(*keys, (reason != "INDEX_UP_TO_DATE").alias("reindex_required"), reason.alias("reason"))


def knowledge_base_counts(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(index_name, index_version, documents, chunks, embeddings) of tables that carry both keys."""
    keys = ["index_name", "index_version"]
    each = [t.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, t in (("documents", documents), ("chunks", chunks), ("embeddings", embeddings))]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy(*keys).pivot("kind", ["documents", "chunks", "embeddings"]).agg(F.coalesce(F.first("n"), F.lit(0)).cast("long")).na.fill(0)


def row_counts(**tables: DataFrame) -> DataFrame:
    """(table, rows) of each."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def index_status(metadata: DataFrame, tables: dict[str, DataFrame], index_name: str | None = None, index_version: str | None = None) -> DataFrame:
    """The latest metadata row of an index (of all if no name is given), with the counts of tables as a map."""
    rows = metadata
    for c, v in (("index_name", index_name), ("index_version", index_version)):
        if v and v.strip():
            rows = rows.filter(F.col(c) == v)
    counts = row_counts(**tables).agg(F.map_from_entries(F.collect_list(F.struct("table", "rows"))).alias("counts"))
    newest = rows.orderBy(F.desc("id")).limit(1)
    return counts.join(newest, F.lit(True), "left")
