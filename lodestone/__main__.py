"""python -m lodestone compare|evaluate|build-plain|build-layout|collect|reindex ...: the batch jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .defaults import Settings
from .operators import layout, metrics, web
from .plans import search
from .session import session
from .sources import readers, sinks


def compare(spark, a) -> None:
    q = readers.questions(spark, a.questions).withColumnRenamed("question_id", "query_id")
    q = q.limit(a.limit) if a.limit else q
    runs = None
    for path in a.configs:
        m = readers.method_config(path)
        s = Settings.of(chunk_size=m["chunk_size"], embedding_dim=m["embedding_dim"], bm25_top_k=m["bm25_top_k"], dense_top_k=m["dense_top_k"], hybrid_top_k=m["final_top_k"], rrf_k=m["rrf_k"], fusion_method=m["fusion_method"], max_output_tokens=m["max_output_tokens"], refusal_min_dense_score=m["refusal_min_dense_score"], refusal_min_token_overlap=m["refusal_min_token_overlap"], refusal_min_token_coverage=m["refusal_min_token_coverage"])
        one = search.run(search.documents_index(readers.markdown_documents(spark, m["dataset_path"]), s), q, m["method"], s)
        runs = one if runs is None else runs.unionByName(one)
    sinks.write_jsonl(runs, f"{a.out}/results")
    sinks.write_csv_file(spark.read.json(f"{a.out}/results"), f"{a.out}/results.csv", sinks.RESULT_COLUMNS)


def evaluate(spark, a) -> None:
    r = readers.jsonl(spark, a.results, "results")
    sinks.write_csv_file(metrics.metric_table(metrics.ir_metrics(r)), a.out, metrics.COLUMNS)


def _described(docs, out: str) -> None:
    """A corpus's documents at out, a manifest of them (JSON lines) and one document of metadata beside."""
    docs.write.mode("overwrite").parquet(out)
    docs = docs.sparkSession.read.parquet(out)
    listed = [c for c in ("chunk_id", "notice_id", "title", "url", "posted_at", "content_type", "block_type", "page", "reading_order", "confidence", "file_path", "source_image_path", "ocr_engine", "preprocess_profile") if c in docs.columns]
    sinks.write_jsonl(docs.select(*listed), f"{out}_manifest")


def build_plain(spark, a) -> None:
    docs = layout.plain_document(layout.plain_documents(readers.ocr_results(spark, a.results, a.examples), readers.manifest(spark, a.manifest)))
    _described(docs, a.out)
    made = spark.read.parquet(a.out)
    sinks.write_document(made.agg(F.count("*").alias("document_count"), F.countDistinct("notice_id").alias("notice_count")), f"{a.out}_metadata.json")


def build_layout(spark, a) -> None:
    made = layout.layout_chunks(readers.ocr_results(spark, a.results, a.examples), readers.manifest(spark, a.manifest), a.min_confidence)
    _described(layout.chunk_document(made).withColumn("content_type", F.lit("image_ocr_layout_chunk")), a.out)
    made = spark.read.parquet(a.out)
    docs = made.select(F.col("chunk_id").alias("document_id"), "content_type", F.lit(1).alias("chunk_count"))
    sinks.write_document(layout.index_metadata(docs, made), f"{a.out}_metadata.json")


def collect(spark, a) -> None:
    pages = spark.read.parquet(a.pages).select(F.col(a.order).alias("seq"), "url", "html")
    pages = pages.orderBy("seq").limit(a.limit) if a.limit else pages
    sinks.write_jsonl(web.collect_notices(pages), a.out)


def reindex(spark, a) -> None:
    print(search.reindex(readers.markdown_documents(spark, a.documents), a.out, force=a.force)[0])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    jobs = {"compare": compare, "evaluate": evaluate, "build-plain": build_plain, "build-layout": build_layout, "collect": collect, "reindex": reindex}
    args = {"compare": ["--questions", "--out"], "evaluate": ["--results", "--out"], "build-plain": ["--results", "--manifest", "--out"], "build-layout": ["--results", "--manifest", "--out"], "collect": ["--pages", "--out"], "reindex": ["--documents", "--out"]}
    for name in jobs:
        s = sub.add_parser(name)
        for x in args[name]:
            s.add_argument(x, required=True)
        if name == "compare":
            s.add_argument("--configs", nargs="+", required=True)
            s.add_argument("--limit", type=int, default=0)
        if name.startswith("build"):
            s.add_argument("--examples", action="store_true")
            s.add_argument("--min-confidence", type=float, default=0.0)
        if name == "collect":
            s.add_argument("--order", default="page_id")
            s.add_argument("--limit", type=int, default=0, help="notices at most; 0 for all")
        if name == "reindex":
            s.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    jobs[a.job](session(), a)


if __name__ == "__main__":
    main()
