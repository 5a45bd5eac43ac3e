"""A training corpus from raw documents: language, copies, near copies, benchmark passages, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, exact, jaccard, langid, piece_codec
from lodestone.llm.common import materialize, table

#: SQL cannot express centroids, signatures or pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language ID rejects. Learns from labelled documents that are not held out.

    Null texts and texts without a letter go; where nothing is labelled, all stay. Long texts are judged whole, repeated
    rows alike. All columns stay, extra ones too. An empty table stays empty.
    """
    return langid.accepted(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id; a null id is larger than all others.

    White space is normalised, null and empty texts are equal, of rows that repeat id and text one stays. All columns
    stay, extra ones too. An empty table stays empty.
    """
    return exact.first_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more), that of the smallest doc_id.

    Texts without words are one group. A null id is larger than all others; of rows that repeat id and text one stays.
    Long texts are compared whole. All columns stay, extra ones too. An empty table stays empty.
    """
    return jaccard.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a passage of the benchmark.

    Null and empty texts have none, nor has any text if the benchmark is empty. Long texts are searched whole, repeated
    rows alike. All columns stay, extra ones too. An empty table stays empty.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids.

    A null or empty text has no pieces. Long texts are encoded whole; each row, repeated or not, is one row. Extra
    columns are not read. An empty table gives no rows.
    """
    return piece_codec.encode(docs)


STAGES = [
    ("language", language),
    ("copies", copies),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; the last one's rows without ids."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, f"stage-{name}") if k < len(STAGES) - 1 else docs
    return docs.drop("ids")
