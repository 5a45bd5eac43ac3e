"""Schemas of the engine's tables and files."""

from __future__ import annotations

from pyspark.sql.types import StructType

_KEYS = "index_name string, corpus_profile string, index_version string"
TABLES = {
    "documents": f"id long, {_KEYS}, notice_id string, title string, source_path string, url string, posted_at timestamp, content_type string, department string, category string, raw_text string, source_hash string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "chunks": f"id long, document_id long, {_KEYS}, chunk_index int, section_name string, page_number int, content string, token_count int, source_image_path string, ocr_engine string, preprocess_profile string, block_type string, bbox array<double>, reading_order int, confidence double, extracted_dates array<string>, extracted_contacts array<string>, created_at timestamp",
    "chunk_embeddings": f"id long, chunk_id long, {_KEYS}, embedding_model string, embedding_dim int, embedding array<float>, created_at timestamp",
    "chat_logs": "id long, question string, answer string, answer_mode string, retrieval_status string, source_labels string, provider string, model string, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd double, latency_ms long, ip_address string, session_id string, created_at timestamp",
    "index_metadata": f"id long, {_KEYS}, document_count int, chunk_count int, corpus_hash string, embedding_model string, embedding_dim int, chunk_size int, chunk_overlap int, tokenizer string, retrieval_config_hash string, source_data_path string, created_at timestamp",
    "bm25_index_metadata": "id long, index_name string, index_version string, tokenizer string, document_count int, chunk_count int, avg_chunk_length double, corpus_hash string, created_at timestamp",
    "retrieval_logs": f"id long, {_KEYS}, question string, chunk_id long, document_id long, notice_id string, bm25_score double, dense_score double, hybrid_score double, bm25_rank int, dense_rank int, hybrid_rank int, top_k int, rrf_k int, fusion_method string, created_at timestamp",
    "experiment_runs": "run_id string, method string, config_hash string, corpus_hash string, question_count int, started_at timestamp, finished_at timestamp, note string",
    "evaluation_questions": "question_id string, question string, question_type string, source_type string, gold_notice_id string, gold_title string, gold_answer string, allowed_answer string, required_field string, difficulty string, memo string",
    "prediction_results": "id long, run_id string, question_id string, method string, answer string, retrieved_notice_ids array<string>, retrieval_scores array<double>, refusal boolean, refusal_reason string, latency_ms double, created_at timestamp",
    "metric_results": "run_id string, method string, subset string, recall_at_1 double, recall_at_3 double, recall_at_5 double, mrr double, ndcg_at_5 double, answer_accuracy double, faithfulness double, source_accuracy double, hallucination_rate double, refusal_accuracy double, avg_latency_ms double, note string",
    "error_analysis_results": "id long, run_id string, question_id string, method string, error_type string, detail string, created_at timestamp",
    "ocr_quality_results": "id long, notice_id string, ocr_engine string, preprocess_profile string, cer double, wer double, date_accuracy double, contact_accuracy double, table_accuracy double, elapsed_seconds double, memo string",
}
BLOCKS = "array<struct<text:string,bbox:array<double>,confidence:double,page:int,block_type:string>>"
FILES = {
    "questions": "question_id string, question string, category string, important boolean, gold_notice_id string, expected_source_keywords array<string>",
    "manifest": "notice_id string, title string, url string, posted_at string, collected_at string, department string, category string, content_type string, raw_text string, attachment_urls array<string>, local_file_path string, source_hash string, downloaded_files array<string>, is_duplicate boolean, duplicate_of string",
    "ocr_results": f"notice_id string, file_path string, ocr_engine string, engine_version string, preprocess_profile string, plain_text string, title string, url string, posted_at string, blocks {BLOCKS}, metadata map<string,string>, sample_type string, expected_features array<string>, elapsed_seconds double, error string",
    "ocr_samples": "notice_id string, file_path string, sample_type string, expected_features array<string>, note string",
    "results": "question_id string, question string, category string, important boolean, gold_notice_id string, method string, answer string, top1_notice_id string, retrieved_notice_ids array<string>, source_titles array<string>, source_urls array<string>, posted_at array<string>, latency_ms double, refusal boolean, refusal_reason string, generation_provider string, generation_model string, temperature double, max_output_tokens int, prompt_version string, run_date string, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd double, top_k int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES.get(name) or FILES[name])


def check_dimension(df, column: str, dim: int):
    """df, with a failure at the first vector of another length."""
    from pyspark.sql import functions as F

    bad = F.size(column) != dim
    return df.withColumn(column, F.when(~bad | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"vector of {dim} numbers expected, found "), F.size(column).cast("string"))).cast(df.schema[column].dataType)))
