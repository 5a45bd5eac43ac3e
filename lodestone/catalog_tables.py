"""More queries of the engine's operators over the test tables, and the same in SQL: files, stored tables, sequences."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from . import defaults
from .catalog import CHUNKS, _BLOCK, _CLEAN, _CUES, _DATES, _GUARDED, _MAILS, _PHONES, _RERANKED, _RETRIEVED, _SEARCHABLE, _SNIPPETS, HYBRID, QUERIES, SQL, _chat, _ocr, _questions, _requests, _retrieved, norm, query, sql_tokens, table
from .functions import numbers, tables, text, vectors
from .operators import answers, chunks, evidence, hashtree, layout, lexical, metrics, provenance, robots, store, vendors, web
from .plans import search, versions
from .sources import readers, sinks, sqlite
from .streaming import jobs
from .tables import shared_folder


def folder(spark, name: str) -> str:
    """A fresh folder that all tasks share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# -- files: written, and read back by the engine's readers


@query("SELECT 'b' || item_id AS question_id, text AS question, CASE item_id % 3 WHEN 0 THEN 'a' ELSE '' END AS category, item_id % 2 = 0 AS important, '' AS gold_notice_id, (item_id % 3)::INT AS n_keywords FROM benchmark")
def questions_file(spark, d):
    i = F.col("item_id")
    out, words = folder(spark, "questions"), F.array(F.lit("x"), F.lit("y"))
    b = table(spark, d, "benchmark").select(F.concat(F.lit("b"), i.cast("string")).alias("question_id"), F.col("text").alias("question"), F.when(i % 3 == 0, "a").alias("category"), F.when(i % 2 == 0, True).alias("important"), F.when(i % 3 > 0, F.slice(words, F.lit(1), (i % 3).cast("int"))).alias("expected_source_keywords"))
    sinks.write_jsonl(b, out, keep_nulls=False)
    return readers.questions(spark, out).withColumn("n_keywords", F.size("expected_source_keywords")).drop("expected_source_keywords")


@query("SELECT 'n' || page_id % 100 AS notice_id, max_by(url, page_id) AS url, 'title ' || max(page_id) AS title FROM pages GROUP BY page_id % 100")
def manifest_file(spark, d):
    """Of notices that are told again and again, the last line counts."""
    p, out = F.col("page_id"), folder(spark, "manifest")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("n"), (p % 100).cast("string")).alias("notice_id"), "url", F.concat(F.lit("title "), p.cast("string")).alias("title"))
    sinks.write_jsonl(rows.coalesce(1).sortWithinPartitions("page_id").drop("page_id"), out)
    return readers.manifest(spark, out).select("notice_id", "url", "title")


@query("""
SELECT CASE conv_id % 2 WHEN 0 THEN 'e0' ELSE 'e1' END AS ocr_engine, 'none' AS preprocess_profile, count(*) FILTER (conv_id % 5 <> 0)::BIGINT AS succeeded, count(*) FILTER (conv_id % 5 = 0)::BIGINT AS failed,
  round(avg(conv_id / 4.0::DOUBLE) FILTER (conv_id % 5 <> 0), 6) AS avg_elapsed_seconds, round(avg(conf) FILTER (conv_id % 5 <> 0), 6) AS avg_confidence
FROM (SELECT conv_id, avg(turn % 4 / 4.0::DOUBLE) AS conf FROM conversations GROUP BY conv_id) GROUP BY ALL""")
def recognised_file(spark, d):
    """Recognised pages, read from a file, by engine."""
    k, out = F.col("conv_id"), folder(spark, "recognised")
    block = F.struct("text", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), (F.col("turn") % 4 / 4.0).alias("confidence"), F.lit(1).alias("page"), F.lit("body").alias("block_type"))
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(block).alias("blocks"))
    r = r.select(F.concat(F.lit("n"), k.cast("string")).alias("notice_id"), F.concat(F.lit("e"), (k % 2).cast("string")).alias("ocr_engine"), F.lit("none").alias("preprocess_profile"), "blocks", (k / 4.0).alias("elapsed_seconds"), F.when(k % 5 == 0, "no text").alias("error"))
    sinks.write_jsonl(r, out)
    return layout.engine_summary(readers.ocr_results(spark, out))


_FILE = "doc_id || '_of_' || lang"


@query(rf"""
SELECT {_FILE} AS document_id, CASE doc_id % 3 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE replace({_FILE}, '_', ' ') END AS title, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END AS url, 'text' AS content_type,
  sha256(CASE doc_id % 3 WHEN 1 THEN chr(10) || '## Head ' || doc_id || chr(10) ELSE '' END || text) AS text_sha256
FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang, CASE doc_id % 3 WHEN 1 THEN '' ELSE chr(10) END || replace({norm('text')}, '#', '') AS text FROM documents)""")
def markdown_files(spark, d):
    """Every document as a Markdown file, with front matter, a heading or neither, read back."""
    k, out = F.col("doc_id"), folder(spark, "markdown")
    own = F.translate(text.normalize(F.col("text")), "#", "")
    n = k.cast("string")
    body = F.when(k % 3 == 0, F.concat(F.lit("---\ntitle: Title "), n, F.lit("\nurl: u"), n, F.lit("\n---\n"), own)).when(k % 3 == 1, F.concat(F.lit("\n## Head "), n, F.lit("\n"), own)).otherwise(F.concat(F.lit("\n"), own))
    files = table(spark, d, "documents").select(F.concat(n, F.lit("_of_"), F.coalesce("lang", F.lit("xx")), F.lit(".md")).alias("path"), body.alias("document"))
    sinks.write_files(files, local(out))
    return readers.markdown_documents(spark, out).select("document_id", "title", "url", "content_type", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CASE doc_id % 2 WHEN 0 THEN 'txt' ELSE 'md' END AS kind, count(*)::BIGINT AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL")
def files_by_kind(spark, d):
    """Files below a folder: those of other endings are passed over."""
    k, out = F.col("doc_id"), folder(spark, "files")
    kind = F.when(k % 5 == 0, "log").when(k % 2 == 0, "txt").otherwise("md")
    sinks.write_files(table(spark, d, "documents").select(F.concat((k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit("."), kind).alias("path"), F.coalesce("text", F.lit("")).alias("document")), local(out))
    return readers.glob_scan(spark, out).groupBy(text.extension(F.col("path")).alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' \"x\", ' || chr(10) || 'y' AS name, '[' || c_nationkey || ',7]' AS keys FROM customer")
def csv_file(spark, d):
    """One CSV file, and what Spark's reader makes of it."""
    out = local(folder(spark, "report")) + ".csv"
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(' "x", \ny')).alias("name"), F.array(F.col("c_nationkey").cast("int"), F.lit(7)).alias("keys"))
    sinks.write_csv_file(c, out, ["c_custkey", "name", "keys"])
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(out)
    return back.toDF("c_custkey", "name", "keys")


@query("SELECT c_custkey, c_mktsegment AS index_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS made FROM customer")
def replaced_partitions(spark, d):
    """Replacing one index leaves the others."""
    out = folder(spark, "index")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("index_name"), F.lit("v1").alias("index_version"))
    sinks.replace_index(c.withColumn("made", F.lit("old")), out)
    sinks.replace_index(c.filter("index_name = 'BUILDING'").withColumn("made", F.lit("new")), out)
    return spark.read.parquet(out).select("c_custkey", "index_name", "made")


@query("SELECT event_type, 2 * count(*)::BIGINT AS n FROM events GROUP BY ALL")
def appended_log(spark, d):
    out = folder(spark, "log")
    for _ in range(2):
        sinks.append_log(table(spark, d, "events"), out, ("event_type",))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 9 AS id, o_orderkey FROM orders")
def numbered_rows(spark, d):
    return sinks.with_ids(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 10).select("id", "o_orderkey")


# -- streams that run: files arrive in the order of time, and each run takes what is new


def _arrived(spark, rows, src: str, parts: int = 3):
    """Writes rows to src in parts by time, and yields after each."""
    at = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)], 100).alias("at")).first()["at"] or []  # a few numbers
    part = F.lit(0)
    for x in at:
        part = part + (F.unix_micros("ts") > x).cast("int")
    for k in range(parts):
        rows.filter(part == k).write.mode("append").parquet(src)
        yield spark.readStream.schema(rows.schema).parquet(src)


@query()
def stream_admissions(spark, d):
    """The rate limiter as a stream of three runs: addresses, then sessions, with state between the runs."""
    src, out, held = folder(spark, "requests"), folder(spark, "admitted"), folder(spark, "admission-checkpoint")
    s = defaults.Settings.of(ip_minute_limit=2, ip_daily_limit=30, session_minute_limit=1, session_daily_limit=4, rate_window_seconds=600)
    requests = _requests(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for arrived in _arrived(spark, requests, src):
        told = jobs.admissions(arrived, s)
        jobs.run_available(told, jobs.batch_folder(out), held)
    return spark.read.schema(told.schema).parquet(out).select(*told.columns).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, event_type, ts FROM events")
def stream_appended_log(spark, d):
    """A log that a stream appends to; the second run breaks off after it has written, and is run again."""
    src, out, held = folder(spark, "events"), folder(spark, "stream-log"), folder(spark, "log-checkpoint")
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    put = jobs.batch_folder(out)

    def breaks_off(batch, number):
        put(batch, number)
        raise RuntimeError("broken off")

    for k, arrived in enumerate(_arrived(spark, rows, src)):
        if k == 1:
            try:
                jobs.run_available(arrived, breaks_off, held)
            except StreamingQueryException:
                pass
        jobs.run_available(arrived, put, held)
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(SQL["stream_first_wins"])
def stream_first_of_hash(spark, d):
    """The first row of each hash, of a stream of three runs."""
    src, out, held = folder(spark, "hashes"), folder(spark, "firsts"), folder(spark, "firsts-checkpoint")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.concat(F.col("user_id").cast("string"), "event_type").alias("source_hash"))
    for arrived in _arrived(spark, rows, src):
        jobs.run_available(jobs.first_rows(arrived), jobs.batch_folder(out), held)
    return spark.read.schema(rows.schema).parquet(out).select("source_hash", F.col("ts").cast("timestamp_ntz").alias("ts"))


# -- stored tables

_NAMED = "doc_id AS id, coalesce(lang, 'xx') AS index_name, 'v1' AS index_version"


def _stored_tables(spark, d):
    keys = (F.coalesce("lang", F.lit("xx")).alias("index_name"), F.lit("v1").alias("index_version"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), *keys, F.col("source").alias("title"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("notice_id"), F.lit("").alias("url"), F.lit(None).cast("string").alias("posted_at"))
    parts = table(spark, d, "documents").select((F.col("doc_id") + 7).alias("id"), F.col("doc_id").alias("document_id"), *keys, F.length("text").alias("size"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 2 == 0, "m").otherwise("other").alias("embedding_model"), F.size("embedding").alias("embedding_dim"), "embedding")
    return docs, parts, e


@query("""
SELECT doc_id + 7 AS id, doc_id AS document_id, source AS title, 'n' || doc_id AS notice_id, length(text)::INT AS size, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 4) AS weight
FROM documents JOIN embeddings ON vec_id = doc_id + 7 WHERE lang = 'en' AND vec_id % 2 = 0""")
def embedded_chunks(spark, d):
    """Chunks of one index with their documents and the vectors of one model."""
    docs, parts, e = _stored_tables(spark, d)
    got = store.embedded_chunks(parts, docs, e.withColumn("index_name", F.lit("en")).withColumn("index_version", F.lit("v1")), "en", "v1", "m")
    weight = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return got.select("id", "document_id", "title", "notice_id", "size", F.round(weight, 4).alias("weight"))


@query("SELECT doc_id + 7 AS id, source AS title FROM documents WHERE coalesce(lang, 'xx') = 'fr'")
def documented_chunks(spark, d):
    docs, parts, _ = _stored_tables(spark, d)
    return store.documented_chunks(parts, docs, index_name="fr", index_version=" ").select("id", "title")


@query("SELECT n AS index_name, n IN (SELECT lang FROM documents) AS known FROM (VALUES ('en'), ('fr'), ('zz')) t(n)")
def knowledge_bases(spark, d):
    docs, parts, _ = _stored_tables(spark, d)
    return spark.createDataFrame([(n, store.has_knowledge_base(docs, parts, docs, n, "v1")) for n in ("en", "fr", "zz")], "index_name string, known boolean")


@query("""
SELECT o_orderpriority AS provider, o_orderstatus AS model, count(*)::BIGINT AS answers, sum(o_custkey)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, coalesce(sum(o_custkey + o), 0)::BIGINT AS total_tokens, round(sum((o_orderkey % 100) / 128.0::DOUBLE), 9) AS estimated_cost_usd
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS o FROM orders) GROUP BY ALL""")
def usage_totals(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("input_tokens"), F.when(k % 3 > 0, k % 50).alias("output_tokens"), ((k % 100) / 128.0).alias("estimated_cost_usd"))
    return store.usage_totals(o.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


@query("SELECT max(o_orderkey) AS id, any_value((SELECT count(*) FROM customer))::BIGINT AS customers, any_value((SELECT count(*) FROM part))::BIGINT AS parts FROM orders WHERE o_orderstatus = 'F'")
def index_status(spark, d):
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("index_name"), F.lit("v1").alias("index_version"))
    s = provenance.index_status(meta, {"customers": table(spark, d, "customer"), "parts": table(spark, d, "part")}, "F", " ")
    return s.select("id", F.col("counts")["customers"].alias("customers"), F.col("counts")["parts"].alias("parts"))


@query("""
SELECT document_count::BIGINT AS document_count, text_document_count::BIGINT AS text_document_count, chunk_count::BIGINT AS chunk_count, layout_document_count::BIGINT AS layout_chunk_document_count
FROM (SELECT count(*) AS document_count, count(*) FILTER (doc_id % 2 = 0) AS text_document_count, sum(doc_id % 4) AS chunk_count, count(*) FILTER (doc_id % 2 = 1) AS layout_document_count FROM documents)""")
def corpus_metadata(spark, d):
    k = F.col("doc_id")
    text_docs, other = (table(spark, d, "documents").filter(k % 2 == r).select(k.alias("document_id"), F.lit(kind).alias("content_type"), (k % 4).cast("int").alias("chunk_count")) for r, kind in ((0, "text"), (1, "image_ocr_layout_chunk")))
    return layout.index_metadata(layout.corpus(text_docs, other.drop("nothing")), _ocr(spark, d)).select("document_count", "text_document_count", "chunk_count", "layout_chunk_document_count")


# -- expressions

_STEM = "regexp_replace(regexp_replace(f, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(f, '\.[^.]*$', ''), '_', ' '), '^\s+|\s+$', '', 'g'), '^.*/', '') AS file_title,
  CASE WHEN doc_id % 3 = 0 THEN 'image_ocr_plain' WHEN doc_id % 3 = 1 THEN 'image_ocr_layout_chunk' ELSE 'text' END AS content_type,
  '[' || doc_id || ',' || (doc_id + 1) || ']' AS literal, CASE WHEN doc_id % 2 = 0 THEN 'big' ELSE 'small' END AS model
FROM (SELECT doc_id, ['c/ocr_plain/x/', 'c/ocr_layout/layout_chunks/', 'c/text/'][doc_id % 3 + 1] || doc_id || '_' || source || '.md' AS f FROM documents)""")
def file_names(spark, d):
    k = F.col("doc_id")
    name = F.concat(k.cast("string"), F.lit("_"), "source", F.lit(".md"))
    path = F.concat(F.when(k % 3 == 0, "c/ocr_plain/x/").when(k % 3 == 1, "c/ocr_layout/layout_chunks/").otherwise("c/text/"), name)
    model = numbers.effective_model(k % 2 == 0, F.lit("small"), F.lit("big"))
    return table(spark, d, "documents").select("doc_id", text.title_from_filename(name).alias("file_title"), text.infer_content_type(F.concat(F.lit("/"), path)).alias("content_type"), text.vector_literal(F.array(k, k + 1)).alias("literal"), model.alias("model"))


_RULES = "'" + text.ANSWER_RULES.replace("'", "''") + "'"


@query(f"""
SELECT conv_id, turn, sha256('질문:' || chr(10) || text || chr(10) || chr(10) || '근거 문서:' || chr(10) || 'source_title: ' || role || chr(10) || 'posted_at: ' || CASE WHEN turn % 2 = 0 THEN '2026' ELSE 'unknown' END || chr(10) || 'url: unknown' || chr(10)
  || CASE WHEN turn % 2 = 1 THEN 'page: ' || turn || chr(10) ELSE '' END || 'section: S' || chr(10) || 'content:' || chr(10) || 'c' || conv_id || chr(10) || chr(10) || {_RULES}) AS prompt_sha256 FROM conversations""")
def prompts(spark, d):
    t = F.col("turn")
    one = F.struct(F.col("role").alias("title"), F.when(t % 2 == 0, "2026").alias("posted_at"), F.lit(" ").alias("url"), F.when(t % 2 == 1, t).alias("page"), F.lit("S").alias("section"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("content"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.user_prompt(F.col("text"), F.array(one)), 256).alias("prompt_sha256"))


@query("SELECT c_custkey, least(greatest(c_nationkey, 1), 20)::INT AS n_sources FROM customer WHERE c_nationkey > 0")
def answer_footers(spark, d):
    n = F.least(F.greatest("c_nationkey", F.lit(1)), F.lit(20)).cast("int")
    source = F.struct(F.col("c_name").alias("title"), F.lit(None).cast("string").alias("posted_at"), F.lit("").alias("url"))
    told = text.with_sources(F.lit(" a "), F.array_repeat(source, n))
    return table(spark, d, "customer").filter("c_nationkey > 0").select("c_custkey", F.regexp_count(told, F.lit("\n- 제목: Customer#[0-9]+\n  게시일: 게시일 미상\n  URL: URL 없음")).alias("n_sources"))


# -- sections and packing, on texts with headings and paragraphs

_PARAGRAPHS = rf"regexp_replace({norm('text')}, '\. ', '.' || chr(10) || chr(10), 'g')"


@query(rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, string_split(regexp_replace({_PARAGRAPHS}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)) AS ps FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, 0 AS sec, 'Document' AS section, ps[1:1] AS ps FROM t UNION ALL SELECT doc_id, 1, 'Part ' || doc_id, ps[2:] FROM t),
p AS MATERIALIZED (SELECT doc_id, sec, section, list_filter(list_transform(ps, lambda x: {norm('x')}), lambda x: x <> '') AS ps FROM s),
f AS (
  SELECT doc_id, sec, section, ps, 1 AS i, '' AS held, []::VARCHAR[] AS done FROM p
  UNION ALL
  SELECT doc_id, sec, section, ps, i + 1,
    CASE WHEN length(ps[i]) > 700 THEN '' WHEN length(held) + length(ps[i]) + 2 > 700 AND length(held) >= 180 THEN ps[i] WHEN held = '' THEN ps[i] ELSE held || chr(10) || chr(10) || ps[i] END,
    CASE WHEN length(ps[i]) > 700 THEN list_concat(CASE WHEN held = '' THEN done ELSE list_append(done, held) END, list_transform(range(0, (length(ps[i]) + 619) // 620), lambda k: regexp_replace(substr(ps[i], k * 620 + 1, 620), '^\s+|\s+$', '', 'g')))
      WHEN length(held) + length(ps[i]) + 2 > 700 AND length(held) >= 180 THEN list_append(done, held) ELSE done END
  FROM f WHERE i <= len(ps)),
c AS (SELECT doc_id, sec, section, CASE WHEN held = '' THEN done ELSE list_append(done, held) END AS cs FROM f WHERE i = len(ps) + 1),
u AS (SELECT doc_id, sec, section, unnest(cs) AS text, generate_subscripts(cs, 1) AS k FROM c)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1)::INT AS chunk_index, section, text FROM u""")
def packed_chunks(spark, d):
    """Texts cut into paragraphs behind full stops, the second and all that follow below a heading."""
    t = F.regexp_replace(text.normalize(F.col("text")), r"\. ", ".\n\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    headed = F.concat_ws("\n\n", F.element_at(F.split(t, "\n\n"), 1), F.concat(F.lit("# Part "), F.col("doc_id").cast("string")), F.when(F.size(F.split(t, "\n\n")) > 1, F.regexp_replace(t, r"(?s)^.*?\n\n", "")))
    return chunks.chunk_table(table(spark, d, "documents").select("doc_id", headed.alias("text"))).select("document_id", "chunk_index", "section", "text")


@query(rf"""
WITH t AS (SELECT doc_id, string_split({_PARAGRAPHS}, chr(10) || chr(10)) AS ps FROM documents),
s AS (SELECT doc_id, 0 AS i, 'Document' AS section, {norm('ps[1]')} AS text FROM t UNION ALL SELECT doc_id, 1, 'Part ' || doc_id, {norm("array_to_string(ps[2:], chr(10) || chr(10))")} FROM t)
SELECT doc_id AS document_id, section, sha256(text) AS text_sha256 FROM s WHERE text <> ''""")
def headed_sections(spark, d):
    t = F.regexp_replace(text.normalize(F.col("text")), r"\. ", ".\n\n")
    headed = F.concat_ws("\n\n", F.element_at(F.split(t, "\n\n"), 1), F.concat(F.lit("### Part "), F.col("doc_id").cast("string")), F.when(F.size(F.split(t, "\n\n")) > 1, F.regexp_replace(t, r"(?s)^.*?\n\n", "")))
    return chunks.section_table(table(spark, d, "documents").select("doc_id", headed.alias("text"))).select("document_id", "section", F.sha2("text", 256).alias("text_sha256"))


# -- the same by SQL table functions


def _by_sql(spark, rows, sql: str):
    """sql over rows, which it calls {rows}; the functions of functions.tables are known to it."""
    tables.register(spark)
    name = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    return spark.sql(sql.format(rows=name))


def _headed(spark, d, mark: str):
    t = F.regexp_replace(F.regexp_replace(text.normalize(F.col("text")), r"\. ", ".\n\n"), r"\n{3,}", "\n\n")
    head, rest = F.element_at(F.split(t, "\n\n"), 1), F.when(F.size(F.split(t, "\n\n")) > 1, F.regexp_replace(t, r"(?s)^.*?\n\n", ""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws("\n\n", head, F.concat(F.lit(f"{mark} Part "), F.col("doc_id").cast("string")), rest).alias("text"))


@query(SQL["packed_chunks"])
def sql_packed_chunks(spark, d):
    return _by_sql(spark, _headed(spark, d, "#"), "SELECT CAST(document_id AS BIGINT) AS document_id, chunk_index, section, text FROM packed_chunks(TABLE(SELECT document_id, text FROM {rows}))")


@query(SQL["headed_sections"])
def sql_headed_sections(spark, d):
    return _by_sql(spark, _headed(spark, d, "###"), "SELECT CAST(document_id AS BIGINT) AS document_id, section, sha2(text, 256) AS text_sha256 FROM headed_sections(TABLE(SELECT document_id, text FROM {rows}))")


# -- web pages


@query("""
SELECT url, m.s AS seed, m.p AS position FROM (SELECT url, min({'s': seed, 'p': position}) AS m FROM (
  SELECT 'http://h/' || lpad(page_id::VARCHAR, 9, '0') AS seed, k AS position, 'http://h/b/boardview/' || (page_id % 7) || '/' || ((page_id + k) % 50) AS url FROM pages, (VALUES (0::BIGINT), (1), (2)) t(k)) GROUP BY url)""")
def discovered_notices(spark, d):
    """Notices that pages link to, each where it is first seen; links to other hosts and to other things are passed over."""
    p = F.col("page_id")
    link = lambda host, k: F.concat(F.lit(f'<a href="{host}/b/boardview/'), (p % 7).cast("string"), F.lit("/"), ((p + k) % 50).cast("string"), F.lit('#x">t</a>'))
    html = F.concat("html", link("", 0), link("http://h", 1), link("http://other", 5), link("", 2))
    return web.discover(table(spark, d, "pages").select(F.concat(F.lit("http://h/"), F.lpad(p.cast("string"), 9, "0")).alias("url"), html.alias("html")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def consecutive_unique(spark, d):
    return web.consecutive_unique(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


_SEEN = "html"
for _a, _b in (("(?s)<!--.*?-->", "''"), ("(?s)<script.*?</script>", "''"), ("(?s)<style.*?</style>", "''"), (r"(?i)</?(p|div|li|br|tr|td|th|h1|h2|h3|h4|section|article)(\s[^>]*)?>", "chr(10)"), ("<[^>]*>", "''"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&quot;?", "'\"'"), ("&middot;?", "'·'"), ("&copy;?", "'©'"), ("&amp;?", "'&'")):
    _SEEN = f"regexp_replace({_SEEN}, '{_a}', {_b}, 'g')"
_LINES = rf"list_filter(list_transform(string_split({_SEEN}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '')"
VISIBLE = f"SELECT page_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), chr(10)) AS text FROM (SELECT page_id, {_LINES} AS l FROM pages)"


# -- sequences: decisions that depend on decisions

_ASKED = "e AS MATERIALIZED (SELECT event_id AS request_id, ts, epoch_ms(ts) AS ms, '10.0.0.' || (user_id % 8) AS ip, user_id::VARCHAR AS session_id, ts::DATE AS day FROM events)"


def _fold(name: str, src: str, key: str, minute: int, daily: int, window: int) -> str:
    """The rule, row by row, as a recursion over each key's day."""
    return f"""
{name}n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key}, day ORDER BY ts, request_id) AS n FROM {src}),
{name}r AS (
  SELECT {key} AS k, day, 0::BIGINT AS n, []::BIGINT[] AS times, 0 AS cnt, NULL::BIGINT AS request_id, NULL::VARCHAR AS reason FROM {name}n WHERE n = 1
  UNION ALL
  SELECT k, day, n, CASE WHEN reason IS NULL THEN list_append(live, ms) ELSE live END, CASE WHEN reason IS NULL THEN cnt + 1 ELSE cnt END, request_id, reason FROM (
    SELECT *, CASE WHEN len(live) >= {minute} THEN 'MINUTE_LIMIT' WHEN cnt >= {daily} THEN 'DAILY_LIMIT' END AS reason FROM (
      SELECT r.k, r.day, s.n, r.cnt, s.ms, s.request_id, list_filter(r.times, lambda x: x >= s.ms - {1000 * window}) AS live FROM {name}r r JOIN {name}n s ON s.{key} = r.k AND s.day = r.day AND s.n = r.n + 1)))"""


RATE = f"""
WITH RECURSIVE {_ASKED},{_fold('a', 'e', 'ip', 2, 30, 600)},
p AS MATERIALIZED (SELECT e.* FROM e JOIN ar USING (request_id) WHERE ar.reason IS NULL),{_fold('b', 'p', 'session_id', 1, 4, 600)}
SELECT request_id, e.ts, e.ip, e.session_id, ar.reason IS NULL AND br.reason IS NULL AS admitted, coalesce('IP_' || ar.reason, 'SESSION_' || br.reason) AS reason
FROM e JOIN ar USING (request_id) LEFT JOIN br USING (request_id)"""

COOLDOWN = f"""
WITH RECURSIVE {_ASKED},
a AS (
  SELECT ip, min(ms) AS ms FROM e GROUP BY ip
  UNION ALL SELECT a.ip, min(e.ms) FROM a JOIN e ON e.ip = a.ip AND e.ms >= a.ms + 3600000 GROUP BY a.ip)
SELECT request_id, ts, ip AS index_name, (ip, ms) IN (SELECT (ip, ms) FROM a) AND row_number() OVER (PARTITION BY ip, ms ORDER BY ts, request_id) = 1 AS accepted FROM e"""

# -- answers

_DEMO_Q = f"SELECT item_id AS query_id, {sql_tokens('evidence', 'text')} AS q FROM benchmark"
DEMO = rf"""
WITH {_RERANKED},
ds0 AS (SELECT query_id, rank, similarity, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS l FROM rr),
ds1 AS (SELECT query_id, rank, similarity, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM ds0),
ds AS (SELECT query_id, rank, similarity, pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS text FROM ds1),
sen AS (SELECT ds.query_id, ds.text, rank, pos, 2.0::DOUBLE * len(list_filter(q, lambda x: list_contains({sql_tokens('evidence', 'ds.text')}, x))) + similarity AS score FROM ds JOIN ({_DEMO_Q}) dq ON dq.query_id = ds.query_id WHERE ds.text <> ''),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, rank, pos) AS c FROM sen),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS n FROM one WHERE c = 1 QUALIFY n <= 3),
j AS (SELECT query_id, string_agg(text, ' ' ORDER BY n) AS a FROM best GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN a IS NULL THEN '{answers.NOTHING_FOUND}' WHEN ends_with(a, '.') THEN a ELSE a || '입니다.' END AS answer FROM benchmark LEFT JOIN j ON query_id = item_id"""


# -- recognised pages as documents

_ORDERED = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_QUOTE = lambda l: f"'[' || array_to_string(list_transform({l}, lambda x: '\"' || replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'), ', ') || ']'"
_BOX = "'[0.0, ' || (turn * 10.0::DOUBLE)::VARCHAR || ', 5.0, ' || (turn * 10.0::DOUBLE + 5)::VARCHAR || ']'"
LAYOUT = f"""
WITH {_BLOCK}, x AS (SELECT *, CASE WHEN conv_id = 1 THEN 'Layout-aware OCR - n1' ELSE 'title n' || conv_id END AS title, CASE WHEN conv_id <> 1 THEN 'http://x' ELSE '' END AS url, CASE WHEN conv_id <> 1 THEN '2026' ELSE '' END AS posted_at FROM bt)
SELECT 'layout_n' || conv_id || '_1_' || printf('%04d', reading_order) AS chunk_id,
  '---' || chr(10) || 'notice_id: n' || conv_id || chr(10) || 'source_image_path: x.png' || chr(10) || 'ocr_engine: engine' || chr(10) || 'engine_version: 1' || chr(10) || 'preprocess_profile: none' || chr(10) || 'content_type: image_ocr_layout_chunk' || chr(10)
  || 'block_type: ' || block_type || chr(10) || 'bbox: ' || {_BOX} || chr(10) || 'page: 1' || chr(10) || 'reading_order: ' || reading_order || chr(10) || 'confidence: ' || confidence || chr(10) || 'title: ' || title || chr(10) || 'url: ' || url || chr(10) || 'posted_at: ' || posted_at || chr(10)
  || 'extracted_dates: ' || {_QUOTE(_ORDERED(_DATES))} || chr(10) || 'extracted_contacts: ' || {_QUOTE(_ORDERED(f"list_concat({_PHONES}, {_MAILS})"))} || chr(10) || '---' || chr(10) || chr(10)
  || '# ' || title || chr(10) || chr(10) || '- block_type: ' || block_type || chr(10) || '- reading_order: ' || reading_order || chr(10) || '- confidence: ' || printf('%.4f', confidence) || chr(10) || '- bbox: ' || {_BOX} || chr(10) || chr(10)
  || CASE block_type WHEN 'title' THEN '# ' || text ELSE text END || chr(10) AS document
FROM x"""

# -- guarded answers

CHAT = rf"""
WITH {_RETRIEVED}, {_GUARDED},
b AS (SELECT query_id, max(dense_score) AS top, max(overlap) AS overlap, any_value(n) AS n, max((overlap >= 1 AND overlap / n >= 0.3)::INT) AS relevant FROM ov GROUP BY query_id),
gate AS MATERIALIZED (SELECT query_id, question, CASE WHEN top IS NULL THEN 'NO_RETRIEVAL' WHEN top < 0.22 THEN 'LOW_DENSE_SCORE' WHEN ({_CUES}) AND overlap / n < 1 THEN 'OUT_OF_DOMAIN_CUE' WHEN relevant = 0 THEN 'LOW_LEXICAL_RELEVANCE' ELSE 'MATCHED' END AS status FROM g LEFT JOIN b USING (query_id)),
ce AS (SELECT item_id AS query_id, {sql_tokens('evidence', 'text')} AS q FROM benchmark),
back AS (SELECT r.*, ce.q FROM ret r JOIN ov USING (query_id, id) JOIN gate USING (query_id) JOIN ce USING (query_id) WHERE gate.status = 'MATCHED' AND ov.overlap >= 1 AND ov.overlap / ov.n >= 0.3),
cr0 AS (SELECT query_id, id, title, content, q, dense_score AS similarity, len(list_filter(q, lambda x: list_contains(t, x))) AS overlap FROM (SELECT *, {sql_tokens('evidence', _SEARCHABLE)} AS t FROM back)),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap * 10.0::DOUBLE + similarity DESC, similarity DESC, id) AS rank FROM cr0 WHERE similarity >= 0.18 OR overlap > 0),
cx AS MATERIALIZED (SELECT * FROM (SELECT *, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM cr) WHERE used <= 3600 OR rank = 1),
ds0 AS (SELECT query_id, rank, similarity, q, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS l FROM cx),
ds1 AS (SELECT query_id, rank, similarity, q, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM ds0),
ds AS (SELECT query_id, rank, similarity, q, pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS text FROM ds1),
sen AS (SELECT query_id, text, rank, pos, 2.0::DOUBLE * len(list_filter(q, lambda x: list_contains({sql_tokens('evidence', 'text')}, x))) + similarity AS score FROM ds WHERE text <> ''),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, rank, pos) AS c FROM sen),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS n FROM one WHERE c = 1 QUALIFY n <= 3),
j AS (SELECT query_id, string_agg(text, ' ' ORDER BY n) AS a FROM best GROUP BY query_id),
foot AS (SELECT query_id, string_agg(chr(10) || '- 제목: ' || title || chr(10) || '  게시일: 게시일 미상' || chr(10) || '  URL: URL 없음', '' ORDER BY rank) AS foot, string_agg(title || ' / Document', ' | ' ORDER BY rank) AS labels FROM cx WHERE rank <= 3 GROUP BY query_id),
told AS (SELECT query_id, CASE WHEN a IS NULL THEN '{answers.NOTHING_FOUND}' WHEN ends_with(a, '.') THEN a ELSE a || '입니다.' END || chr(10) || chr(10) || '근거:' || foot AS answer, labels FROM foot LEFT JOIN j USING (query_id)),
chat AS (SELECT query_id, CASE WHEN status = 'MATCHED' AND answer IS NULL THEN 'NO_MATCH' ELSE status END AS status, CASE WHEN status <> 'MATCHED' THEN '{defaults.REFUSAL_MESSAGE}' WHEN answer IS NULL THEN '{defaults.NO_MATCH_MESSAGE}' ELSE answer END AS answer, labels FROM gate LEFT JOIN told USING (query_id))"""


@query(CHAT + " SELECT query_id, status AS retrieval_status, answer, coalesce(labels, '') AS source_labels FROM chat")
def chat_log_rows(spark, d):
    """Guarded answers as log rows."""
    return sinks.chat_log(_chat(spark, d)).drop("created_at")


@query(CHAT + " SELECT query_id, status = 'MATCHED' AS answered, CASE WHEN status = 'MATCHED' THEN CASE query_id % 3 WHEN 0 THEN 'mock' ELSE 'p' END END AS provider, CASE WHEN status = 'MATCHED' THEN CASE query_id % 3 WHEN 0 THEN 'ValueError: empty answer' END END AS fallback_reason FROM chat")
def generated_answers(spark, d):
    """A generator chosen by name answers what the guard lets through; where it gives nothing, the extracted answer stands in."""
    from .operators.generation import Provider, generate, routed

    def call(question: str, prompt: str, model: str) -> dict:
        n = int(prompt.partition("#")[2].partition("#")[0])
        return {"answer": "" if n % 3 == 0 else "made", "input_tokens": len(prompt), "output_tokens": 1}

    provider = routed("P ", {"p": Provider("p", "m", call), "other": Provider("other", "m", call)})
    r = _retrieved(spark, d).withColumn("page", F.lit(None).cast("int")).withColumn("url", F.lit("")).withColumn("posted_at", F.lit(None).cast("timestamp"))
    made = {}

    def run(rows):
        made["rows"] = generate(rows.withColumn("prompt", F.concat(F.lit("#"), F.col("query_id").cast("string"), F.lit("#"), "prompt")), provider)
        return made["rows"].select("query_id", "answer")

    told = answers.chat(_questions(spark, d), r, generate=run)
    out = told.join(made["rows"].select("query_id", "provider", "fallback_reason"), "query_id", "left")
    return out.select("query_id", (F.col("status") == "MATCHED").alias("answered"), "provider", "fallback_reason")


# -- notices

NOTICES = f"""
WITH v AS MATERIALIZED ({VISIBLE}),
n AS (SELECT page_id AS seq, 'notice_' || substr(sha256(url), 1, 12) AS notice_id, coalesce(nullif({_CLEAN}, ''), '{web.NO_TITLE}') AS title, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS department, v.text AS raw_text FROM pages JOIN v USING (page_id)),
h AS (SELECT *, sha256(title || chr(10) || raw_text) AS source_hash FROM n),
f AS (SELECT *, first_value(seq) OVER w AS s0, first_value(notice_id) OVER w AS n0 FROM h WINDOW w AS (PARTITION BY source_hash ORDER BY seq))
SELECT seq, notice_id, title, url, NULL::VARCHAR AS posted_at, '' AS collected_at, department, '공지' AS category, raw_text, '' AS attachment_urls, 'text' AS content_type, source_hash, seq <> s0 AS is_duplicate, CASE WHEN seq <> s0 THEN n0 END AS duplicate_of FROM f"""


@query("SELECT page_id, list_sort(['http://h/f/' || page_id || '.PDF', 'http://o/i.png']) AS files FROM pages")
def page_attachments(spark, d):
    """Files that pages link to or show, below whole pages' own html."""
    p = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="get?file=/f/'), p, F.lit('.PDF">f</a><img src="http://o/i.png"><a href="javascript:go()">g</a><a href="/site/resource/a.png">h</a>'), "html")
    return table(spark, d, "pages").select("page_id", F.array_sort(web.notice_parts(html, F.concat(F.lit("http://h/x/"), p))["files"]).alias("files"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN [text] ELSE [text, 'own'] END AS lines FROM conversations
WHERE NOT regexp_matches(text, '^(COPYRIGHT|최종수정일|Dept. of|Department of|info )|Total :|게시판$') AND trim(text) NOT IN ('', 'own', 'T', '*', 'Q&A') AND text = trim(text)""")
def section_lines(spark, d):
    """A page's own lines: without menus, boilerplate, dates, names, repeats, and what follows the stop line."""
    c = table(spark, d, "conversations")
    lines = F.concat(F.array(F.lit("하위메뉴"), F.col("text"), F.col("text"), F.lit("Total : 3"), F.lit("2026.01.02"), F.lit("Facebook"), F.lit("menu"), F.lit("T")), F.when(F.col("role") == "user", F.array().cast("array<string>")).otherwise(F.array(F.lit("own"))), F.array(F.lit("stop"), F.lit("after")))
    out = c.select("conv_id", "turn", "text", web.section_lines(lines, F.lit("N"), F.array(F.lit("menu")), F.lit("T"), stop=["stop"]).alias("lines"))
    plain = ~F.col("text").rlike("^(COPYRIGHT|최종수정일|Dept. of|Department of|info )|Total :|게시판$") & ~F.trim("text").isin("", "own", "T", "*", "Q&A") & (F.col("text") == F.trim("text"))
    return out.filter(plain).select("conv_id", "turn", "lines")


@query("SELECT n_name AS name, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey % 4) || '년제' END AS duration, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS capacity FROM nation")
def department_programs(spark, d):
    """Departments with what lines of text say of their programs."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    lines = n.filter(k % 2 == 0).select(k.alias("line_no"), F.concat(F.lit("  - "), "n_name", F.lit(": "), (k % 4).cast("string"), F.lit("년제, 입학정원 "), k.cast("string")).alias("line"))
    return web.with_programs(n.select(F.col("n_name").alias("name"), "n_regionkey"), lines)


@query("""
SELECT '# H' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY r_name) AS markdown FROM (
  SELECT r_name, '## ' || r_name || chr(10) || chr(10) || string_agg('### ' || n_name || chr(10) || '- 공식 학과 페이지: http://' || n_nationkey || chr(10) || '- 학제 참고: 2년제' || chr(10) || '- S' || chr(10) || '  - b' || n_nationkey || chr(10) || '- 학과사무실 참고' || chr(10) || '  - o' || chr(10), chr(10) ORDER BY n_nationkey) AS part
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def department_report(spark, d):
    k = F.col("n_nationkey")
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.array(F.struct(F.lit("S").alias("label"), F.array(F.concat(F.lit("b"), k.cast("string"))).alias("bullets")))
    rec = j.select(k.alias("seq"), F.col("r_name").alias("category"), F.col("n_name").alias("name"), F.concat(F.lit("http://"), k.cast("string")).alias("url"), F.lit("2년제").alias("duration"), F.lit("").alias("capacity"), one.alias("sections"), F.array(F.lit("o"), F.lit("o")).alias("office"))
    names = sorted(r["r_name"] for r in table(spark, d, "region").select("r_name").collect())  # five rows
    return web.department_markdown(rec, names, ["# H", ""])


# -- recognition, extractors, indexes


@query("""
SELECT 'n' || page_id AS notice_id, p AS preprocess_profile, CASE WHEN page_id % 5 > 0 THEN 'n' || page_id || ':' || p END AS plain_text, CASE WHEN page_id % 5 = 0 THEN 'OSError: unreadable' END AS error
FROM pages, (VALUES ('none'), ('basic')) t(p)""")
def recognised_pages(spark, d):
    """Files through an engine, with each profile; one that can't be read is a row with an error."""

    def engine(path: str, notice: str, profile: str) -> dict:
        if int(notice[1:]) % 5 == 0:
            raise OSError("unreadable")
        return {"plain_text": f"{notice}:{profile}", "blocks": []}

    files = table(spark, d, "pages").select(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("notice_id"), F.lit("x.png").alias("file_path"))
    return readers.recognise(files, engine, ["none", "basic"]).select("notice_id", "preprocess_profile", "plain_text", "error")


@query(r"""
SELECT doc_id, (k - 1)::INT AS section_index, 'Page ' || k AS section, k::INT AS page, p AS text FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents))
WHERE regexp_matches(p, '\S')""")
def extracted_pages(spark, d):
    """Pages that an extractor finds in files; those without text have no section."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    out = readers.pdf_sections(files, lambda b: b.decode("utf-8").split(". "))
    return out.select(F.col("path").cast("long").alias("doc_id"), "section_index", "section", "page", "text")


@query("SELECT o_orderkey, [least(o_custkey, 3.0::DOUBLE), o_orderkey % 7, greatest(o_custkey, 3.0::DOUBLE), greatest(o_orderkey % 7, 9.0::DOUBLE)]::DOUBLE[] AS box FROM orders")
def polygon_boxes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    pts = F.array(F.array(c, (k % 7).cast("double")), F.array(F.lit(3.0), F.lit(9.0)))
    return table(spark, d, "orders").select("o_orderkey", layout.polygon_bbox(pts).alias("box"))


@query("SELECT o_orderkey, greatest(1, least(20, v))::BIGINT AS dense, greatest(1, least(20, v))::BIGINT AS bm25, greatest(1, least(50, v))::BIGINT AS top_k, greatest(1, least(500, v))::BIGINT AS candidates, greatest(1, least(1000, v))::BIGINT AS rrf_k FROM (SELECT o_orderkey, o_custkey - 100 AS v FROM orders)")
def clamped_limits(spark, d):
    """Limits that requests ask for, as the bounds of each kind of search allow."""
    v = (F.col("o_custkey") - 100).cast("long")
    of = lambda kind, name: numbers.clamped(v, *defaults.LIMITS[kind][name])
    return table(spark, d, "orders").select("o_orderkey", of("dense", "limit").alias("dense"), of("bm25", "limit").alias("bm25"), of("hybrid", "top_k").alias("top_k"), of("hybrid", "bm25_top_k").alias("candidates"), of("hybrid", "rrf_k").alias("rrf_k"))


_CONFIG = ["retrievalTopK=4", "hybridTopK=5", "bm25TopK=50", "denseTopK=50", "rrfK=60", "fusionMethod=rrf", "minSimilarity=0.18", "responseSourceLimit=3", "refusalMinDenseScore=0.22", "refusalMinTokenOverlap=1", "refusalMinTokenCoverage=0.3", "refusalEvidenceTopK=40", "refusalOutOfDomainCues="]


_CONFIG_SQL = " || ".join(f"'{c.split('=')[0]}=' || {'(o_custkey % 9)' if c.startswith('hybridTopK') else repr(c.split('=')[1])} || chr(0)" for c in _CONFIG)


@query(f"SELECT o_orderkey, sha256({_CONFIG_SQL}) AS config_hash FROM orders")
def settings_hash(spark, d):
    """The hash of the settings of each request, which set one of them."""
    return table(spark, d, "orders").select("o_orderkey", provenance.config_hash(hybridTopK=(F.col("o_custkey") % 9).cast("string")).alias("config_hash"))


@query(f"SELECT conv_id, turn, ({_CUES} OR contains(lower(question), 'the')) AS cue FROM (SELECT conv_id, turn, text AS question FROM conversations)")
def ood_cue_with_own(spark, d):
    """The guard's own cues and a user's."""
    s = defaults.Settings.of(refusal_cues=["the"])
    return table(spark, d, "conversations").select("conv_id", "turn", evidence.has_cue(F.col("text"), s.refusal_cues).alias("cue"))


@query("SELECT * FROM (VALUES (1, 'METADATA_MISSING'), (2, 'INDEX_UP_TO_DATE'), (3, 'CORPUS_HASH_CHANGED'), (4, 'FORCE_REINDEX')) t(step, reason)")
def reindexing(spark, d):
    """An index of the benchmark's texts: built, left, built for other texts, built because it is asked for."""
    out = folder(spark, "engine")
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), F.lit("t").alias("title"), F.lit("p").alias("path"), F.lit("").alias("url"), F.lit(None).cast("string").alias("posted_at"), F.lit("text").alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"), "text")
    other = b.withColumn("text", F.concat("text", F.lit("!")))
    steps = [search.reindex(x, out, force=f)[0] for x, f in ((b, False), (b, False), (other, False), (other, True))]
    return spark.createDataFrame(list(enumerate(steps, 1)), "step int, reason string")


@query(f"WITH {HYBRID} SELECT query_id::VARCHAR AS question, id AS chunk_id, hybrid_rank::INT AS hybrid_rank, 5 AS top_k, 60 AS rrf_k, 'rrf' AS fusion_method FROM hy")
def retrieval_log(spark, d):
    """Rankings as log rows."""
    from .catalog import _chunks

    ix = search.build(_chunks(spark, d).withColumn("metadata", F.create_map().cast("map<string,string>")))
    q = _questions(spark, d)
    log = search.retrieval_log(search.hybrid(ix, q), q.withColumn("question", F.col("query_id").cast("string")), ix)
    return log.select("question", "chunk_id", "hybrid_rank", "top_k", "rrf_k", "fusion_method")


# -- what changed, by a tree of hashes

_DIGEST = "sha256(CASE WHEN lang IS NULL THEN chr(0) ELSE length(lang) || ':' || lang END || CASE WHEN text IS NULL THEN chr(0) ELSE length(text) || ':' || text END)"
_LEAVES = f"SELECT (doc_id // {hashtree.LEAF})::BIGINT AS node, count(*)::BIGINT AS n, sha256(string_agg(doc_id || ':' || {_DIGEST} || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1"


@query(f"""
WITH RECURSIVE top AS (SELECT max(doc_id) // {hashtree.LEAF} AS m FROM documents),
t AS (
  SELECT 0 AS level, * FROM ({_LEAVES})
  UNION ALL SELECT level + 1, node // {hashtree.FAN}, sum(n)::BIGINT, sha256(string_agg(node || ':' || digest || chr(10), '' ORDER BY node)) FROM t, top WHERE m // ({hashtree.FAN} ** level)::BIGINT > 0 GROUP BY level, node // {hashtree.FAN})
SELECT level::INT AS level, node::BIGINT AS node, n, digest FROM t""")
def hash_tree(spark, d):
    return hashtree.tree(hashtree.digests(table(spark, d, "documents"), ["lang", "text"]))


@query("SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'added' ELSE 'changed' END AS kind FROM documents WHERE doc_id % 5 = 0 OR doc_id % 5 = 1 AND text IS NOT NULL UNION ALL SELECT -doc_id - 1, 'deleted' FROM documents WHERE doc_id % 5 = 2")
def hash_tree_changes(spark, d):
    """All documents against the corpus as it was: some were not there, some had another text, some have gone."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 5
    old = docs.filter(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).unionByName(docs.filter(k == 2).withColumn("doc_id", -F.col("doc_id") - 1))
    of = lambda t: hashtree.digests(t, ["lang", "text"])
    return hashtree.changes(of(old), of(docs))


# -- tables in buckets


def _bucketed(spark, d):
    """(chunks, documents, vectors) of all namespaces, as tables of eight buckets."""
    run, docs = uuid.uuid4().hex, table(spark, d, "documents")
    named = lambda t: t.withColumn("index_name", F.coalesce("lang", F.lit("xx"))).withColumn("index_version", F.lit("v1"))
    c = named(chunks.chunk_table(docs.withColumn("lang_", F.col("lang")), keep=["lang"])).select(F.col("chunk_id").alias("id"), "document_id", "chunk_index", F.md5("text").alias("text_md5"), "index_name", "index_version")
    o = named(docs).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("").alias("notice_id"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("posted_at"), "index_name", "index_version")
    v = named(chunks.chunk_table(docs, keep=["lang"])).select("chunk_id", F.lit("hashed").alias("embedding_model"), F.lit(2).alias("embedding_dim"), F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"), "index_name", "index_version")
    return c, o, v, run


_LANG = f"WITH {CHUNKS}, k AS (SELECT chunk.*, source AS title, coalesce(lang, 'xx') AS index_name FROM chunk JOIN documents ON doc_id = document_id)"


@query(f"{_LANG} SELECT id, document_id, chunk_index::INT AS chunk_index, md5(text) AS text_md5, title FROM k WHERE index_name = 'en'")
def bucketed_documented_chunks(spark, d):
    """Chunks of one namespace with their documents: no row moves between tasks."""
    c, o, _, run = _bucketed(spark, d)
    c, o = store.bucketed(c, f"chunks_{run}", "document_id", 8), store.bucketed(o, f"documents_{run}", "id", 8)
    return store.documented_chunks(c, o, "en", "v1").select("id", "document_id", "chunk_index", "text_md5", "title")


@query(f"{_LANG} SELECT id, text_chars, md5(text) AS text_md5 FROM (SELECT *, length(text)::DOUBLE AS text_chars FROM k) WHERE index_name = 'fr'")
def bucketed_chunk_vectors(spark, d):
    """Chunks of one namespace with their vectors: no row moves between tasks."""
    c, _, v, run = _bucketed(spark, d)
    c, v = store.bucketed(c, f"chunks_{run}", "id", 8), store.bucketed(v, f"vectors_{run}", "chunk_id", 8)
    own = {"index_name": "fr", "index_version": "v1"}
    e = store.namespace(v, **own, embedding_model="hashed", embedding_dim=2).select("chunk_id", "embedding")
    return store.namespace(c, **own).join(e, F.col("id") == F.col("chunk_id")).select("id", F.col("embedding")[0].alias("text_chars"), "text_md5")


# -- an index in versions

#: As CHUNKS, of the table d2.
CHUNKS2 = CHUNKS.replace("FROM documents", "FROM d2")


def _as_documents(docs):
    empty = F.lit("")
    return docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), empty.alias("path"), empty.alias("url"), F.lit(None).cast("string").alias("posted_at"), F.lit("text").alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"), "text")


def _earlier(docs):
    """The corpus as it was: without a fifth of its documents, with other texts in another fifth, and with some that have gone since."""
    k = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    there = docs.filter(k != 0).withColumn("text", F.when(k == 1, F.concat(F.lit("an earlier text of "), "text")).otherwise(F.col("text")))
    return there.unionByName(docs.filter(k == 2).withColumn("doc_id", -F.col("doc_id") - 1))


def _updated(spark, d, profile="offline"):
    """The index of all documents, brought there from that of an earlier corpus."""
    docs = table(spark, d, "documents")
    index = versions.VersionedIndex(spark, folder(spark, "versions"), profile=profile)
    index.update(_as_documents(_earlier(docs)))
    return index, index.update(_as_documents(docs))


@query(SQL["bm25_topk_offline"])
def incremental_bm25(spark, d):
    """The same as from an index built at once: only what changed was cut and counted."""
    index, _ = _updated(spark, d)
    return lexical.search(index.read().bm25, _questions(spark, d), 50).withColumn("bm25_score", F.round("bm25_score", 6))


@query(SQL["hybrid_rrf_topk"])
def incremental_hybrid(spark, d):
    index, _ = _updated(spark, d)
    h = search.hybrid(index.read(), _questions(spark, d))
    return h.select("query_id", "id", F.round("bm25_score", 6).alias("bm25_score"), F.round("dense_score", 6).alias("dense_score"), "bm25_rank", "dense_rank", F.round("hybrid_score", 9).alias("hybrid_score"), "hybrid_rank")


@query(f"WITH {CHUNKS} SELECT 'reader of the first' AS reader, 1 AS version, count(*)::BIGINT AS chunks FROM chunk UNION ALL SELECT * FROM (WITH d2 AS (SELECT doc_id, text || ' ' || text AS text FROM documents), {CHUNKS2} SELECT 'after publication', 2, count(*)::BIGINT FROM chunk)")
def published_versions(spark, d):
    """Readers while an update breaks off half-way, and after it has been run again."""
    docs = table(spark, d, "documents")
    index = versions.VersionedIndex(spark, folder(spark, "versions"))
    index.update(_as_documents(docs))

    def breaks_off(step):
        raise RuntimeError(f"broken off after {step}")

    twice = _as_documents(docs.withColumn("text", F.concat("text", F.lit(" "), "text")))
    try:
        index.update(twice, broken=breaks_off)
    except RuntimeError:
        pass
    seen = lambda name, v: index.read(v).chunks.agg(F.count("*").alias("chunks")).select(F.lit(name).alias("reader"), F.lit(v.number).alias("version"), "chunks")
    before = index.current()
    index.update(twice)
    return seen("reader of the first", before).unionByName(seen("after publication", index.current()))


@query("SELECT 'BUILT' AS outcome, count(*)::BIGINT AS documents FROM documents UNION ALL SELECT 'REFUSED', NULL")
def exclusive_update(spark, d):
    """Two updates at once: the second one comes while the first has the index."""
    docs, path = _as_documents(table(spark, d, "documents")), folder(spark, "versions")
    told = []

    def second(step):
        try:
            versions.VersionedIndex(spark, path).update(docs)
        except versions.Refused:
            told.append(("REFUSED", None))

    index = versions.VersionedIndex(spark, path)
    index.update(docs, broken=second)
    built = index.digests(index.current()).agg(F.lit("BUILT").alias("outcome"), F.count("*").alias("documents"))
    return built.unionByName(spark.createDataFrame(told, "outcome string, documents long"))


# -- site structure

_CARD = """concat('<div class="card"><h5 class="x card-title">In ', page_id % 5, '</h5><ul class="list-group list-group-flush"><li><a class="y" href=" /d/', page_id, '">Dep <b>', page_id % 7, '</b></a></li><li><a href="/e/', page_id % 3, '">Other</a></li></ul></div>')"""
_MENU = """concat('<a role="menuitem" href="/content/', page_id % 4, '">About</a><a href="#top" role="menuitem">Top</a><a href="/x/', page_id, '" role="menuitem">Careers and <i>jobs</i></a><a href="/y">Plain</a>')"""


@query("SELECT page_id, 'In ' || page_id % 5 AS category, x.n AS name, x.h AS href FROM (SELECT page_id, unnest([{'n': 'Dep ' || page_id % 7, 'h': '/d/' || page_id}, {'n': 'Other', 'h': '/e/' || page_id % 3}]) AS x FROM pages)")
def site_cards(spark, d):
    """The cards of pages, before the pages' own html."""
    p = table(spark, d, "pages").select("page_id", F.explode(web.department_cards(F.concat(F.expr(_CARD), "html"))).alias("c"))
    return p.select("page_id", "c.category", "c.name", "c.href")


@query("SELECT page_id, 'About' AS label, 'http://h.example/content/' || page_id % 4 AS url, 1 AS place FROM pages UNION ALL SELECT page_id, 'Careers and jobs', 'http://h.example/x/' || page_id, 2 FROM pages")
def site_menu(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(web.menu_items(F.concat(F.expr(_MENU), "html"), F.lit("http://h.example/a/b"))).alias("k", "m"))
    return p.select("page_id", "m.label", "m.url", (F.col("k") + 1).alias("place"))


@query("SELECT page_id, x.l AS label, x.u AS url FROM (SELECT page_id, unnest([{'l': 'Careers and jobs', 'u': 'http://h.example/x/' || page_id}, {'l': 'About', 'u': 'http://h.example/content/' || page_id % 4}]) AS x FROM pages)")
def site_sections(spark, d):
    """The sections that are wanted of a site, in order, from its menu."""
    items = web.menu_items(F.concat(F.expr(_MENU), "html"), F.lit("http://h.example/a/b"))
    p = table(spark, d, "pages").select("page_id", items.alias("items"))
    own = web.choose_sections(F.col("items"), [("work", ["Careers"]), ("about", ["About", "Intro"]), ("again", ["About"])], F.lit("http://h.example/start"))
    return p.select("page_id", F.explode(own).alias("s")).select("page_id", "s.label", "s.url")


# -- what a fetcher may ask for

_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_AFTER = "regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
_JUDGED = f"""
j AS (
  SELECT *, CASE WHEN length(host) % 3 = 0 THEN NULL WHEN starts_with(path, '/en/1') THEN '/en/1' WHEN starts_with(path, '/en/') THEN '/en/' WHEN starts_with(path, '/de/') THEN '/de/' END AS rule
  FROM (SELECT page_id, url, {_HOST} AS host, CASE WHEN starts_with({_AFTER}, '/') THEN {_AFTER} ELSE '/' || {_AFTER} END AS path FROM pages)
), r AS (SELECT page_id, url, host, rule, host <> '' AND coalesce(rule NOT IN ('/en/', '/de/'), true) AS allowed, CASE WHEN length(host) % 3 = 0 THEN 1.0::DOUBLE ELSE (length(host) % 5 + 0.5)::DOUBLE END AS delay FROM j)"""


def _judged(spark, d):
    """Pages by the rules of two thirds of their hosts."""
    p = table(spark, d, "pages").select("page_id", "url")
    hosts = p.select(robots.host_of(F.col("url")).alias("host")).distinct().filter("host <> '' and length(host) % 3 <> 0")
    text = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: third\nDisallow: /en/ # but\nAllow: /en/1\nDisallow: /de/\nDisallow:\nCrawl-delay: "), (F.length("host") % 5).cast("string"), F.lit(".5\n"))
    return robots.judged(p, hosts.withColumn("robots", text), "lodestone")


@query(f"WITH {_JUDGED} SELECT page_id, host, rule, allowed, delay FROM r")
def robots_rules(spark, d):
    return _judged(spark, d).select("page_id", "host", "rule", "allowed", "delay")


@query(f"WITH {_JUDGED} SELECT page_id, host, k AS place, k * delay AS at FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1 AS k FROM r WHERE allowed)")
def fetch_schedule(spark, d):
    return robots.schedule(_judged(spark, d), ["url", "page_id"]).select("page_id", "host", "place", "at")


# -- answers of recognition engines


@query(r"""
SELECT conv_id, turn, shape, CASE WHEN broken THEN 'NOT_JSON' WHEN shape = 'other' THEN 'UNKNOWN_SHAPE' END AS error, (CASE WHEN broken OR shape = 'other' THEN 0 ELSE 2 END)::INT AS n_blocks,
  CASE WHEN broken OR shape = 'other' THEN '' ELSE array_to_string(list_filter([role, regexp_replace(text, '^\s+|\s+$', '', 'g')], lambda x: x <> ''), chr(10)) END AS plain_text,
  CASE WHEN NOT broken AND shape <> 'other' THEN '1.0,' || turn || '.5,9.0,' || (turn + 2) || '.0' END AS box, CASE WHEN NOT broken AND shape <> 'other' THEN CASE shape WHEN 'regions' THEN 'unknown' ELSE 'text' END END AS kind
FROM (SELECT *, ['fields', 'pages', 'lines', 'regions', 'other'][1 + (conv_id + turn) % 5] AS shape, conv_id % 7 = 3 AS broken FROM conversations)""")
def vendor_answers(spark, d):
    """Each turn as an answer of some engine: its role and text as two blocks; some answers are cut off."""
    c, turn = table(spark, d, "conversations"), F.col("turn").cast("string")
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    poly = put("[[1,", turn, ".5],[9,", turn, ".5],[9,", (F.col("turn") + 2).cast("string"), "],[1,", (F.col("turn") + 2).cast("string"), "]]")
    points = F.regexp_replace(poly, r"\[([0-9.]+),([0-9.]+)\]", '{"x":$1,"y":$2}')
    field = lambda t: put('{"inferText":', quoted(t), ',"inferConfidence":0.5,"boundingPoly":{"vertices":', points, "}}")
    box = put("[1.0,", turn, ".5,9,", (F.col("turn") + 2).cast("string"), "]")
    shapes = {
        "fields": put('{"images":[{"fields":[', field("role"), ']},{"fields":[', field("text"), "]}]}"),
        "pages": put("[[[", poly, ",[", quoted("role"), ",0.5]]],null,[[", poly, ",[", quoted("text"), ",0.25]]]]"),
        "lines": put("[[", poly, ",", quoted("role"), ",0.5],[", poly, ",", quoted("text"), ",1]]"),
        "regions": put('[{"bbox":', box, ',"type":"title","res":', quoted("role"), '},{"bbox":', box, ',"type":"figure","res":[{"text":', quoted("text"), "},7]}]"),
        "other": put("{}"),
    }
    shape = F.array(*map(F.lit, shapes))[((F.col("conv_id") + F.col("turn")) % 5).cast("int")]
    answer = F.element_at(F.create_map(*[x for k, v in shapes.items() for x in (F.lit(k), v)]), F.col("shape"))
    a = c.withColumn("shape", shape).withColumn("answer", F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("["), answer)).otherwise(answer))
    last = F.get("blocks", 1)
    return vendors.decoded(a).select("conv_id", "turn", "shape", "error", F.size("blocks").alias("n_blocks"), "plain_text", F.array_join(last["bbox"].cast("array<string>"), ",").alias("box"), last["block_type"].alias("kind"))


# -- reports and small files


@query("SELECT count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS chars, min(lang) AS first_lang FROM documents")
def document_file(spark, d):
    """One row as a JSON file, read back."""
    path = f"{folder(spark, 'document')}/corpus.json"
    one = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.min("lang").alias("first_lang"))
    sinks.write_document(one, path)
    return spark.read.schema(one.schema).option("multiLine", True).json(path)


@query("SELECT n_nationkey, n_name FROM nation")
def reset_folders(spark, d):
    """A folder that held customers, emptied and filled with nations."""
    workspace = folder(spark, "workspace")
    sinks.write_jsonl(table(spark, d, "customer").select("c_custkey"), f"{workspace}/own/rows")
    sinks.reset_folder(spark, f"{workspace}/own", workspace)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.write_jsonl(n, f"{workspace}/own/nations")
    return spark.read.schema(n.schema).option("recursiveFileLookup", True).json(f"{workspace}/own")


_KEPT = {"method", "subset", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5", "refusal_accuracy", "avg_latency_ms"}


@query(f"WITH ir AS ({SQL['ir_metrics']}) SELECT {', '.join(c if c in _KEPT else repr(metrics.NOTE) + ' AS note' if c == 'note' else f'NULL::VARCHAR AS {c}' for c in metrics.COLUMNS)} FROM ir")
def metric_report(spark, d):
    """All columns of a report; what people would have to judge is null."""
    return metrics.metric_table(QUERIES["ir_metrics"](spark, d))


@query(rf"""
SELECT conv_id, turn, coalesce(title, 'OCR plain text - n' || conv_id) AS title, coalesce(url, '') AS url, {norm("text")} AS text
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' || chr(10) ELSE text END AS text FROM conversations) LEFT JOIN (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END AS title FROM pages) ON page_id = conv_id
WHERE regexp_replace(text, '\s+', '', 'g') <> ''""")
def plain_documents(spark, d):
    """Recognised texts as documents; blank ones are left out."""
    c = table(spark, d, "conversations")
    r = c.select(
        F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("notice_id"), F.col("turn").cast("string").alias("file_path"), F.lit("e").alias("ocr_engine"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("posted_at"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.when(F.col("turn") % 3 == 1, " \n").otherwise(F.col("text")).alias("plain_text"))
    k = F.col("page_id")
    m = table(spark, d, "pages").select(F.concat(F.lit("n"), k.cast("string")).alias("notice_id"), F.when(k % 2 == 0, F.concat(F.lit("page "), k.cast("string"))).alias("title"), "url", F.lit(None).cast("string").alias("posted_at"))
    out = layout.plain_documents(r, m)
    return out.select(F.substring("notice_id", 2, 20).cast("long").alias("conv_id"), F.col("file_path").cast("long").alias("turn"), "title", F.coalesce("url", F.lit("")).alias("url"), "text")


# -- databases, limits, settings, reports


@query("SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def jdbc_table(spark, d):
    """A table written to a database and read back by several connections.

    The database is a file that tasks of all processes open, by Python's own driver. Spark brings JDBC drivers of none
    like it: its embedded one is of one process, and the driver's own connection keeps it from the tasks.
    """
    path = local(f"{folder(spark, 'database')}/db")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    sqlite.write_sqlite(c, path, "customer")
    sqlite.write_sqlite(c.limit(0), path, "customer")
    back = sqlite.sqlite_scan(spark, path, "customer", c.schema, 3)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("long").alias("c_nationkey"), F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS length FROM documents WHERE octet_length(encode(text)) <= 2000")
def files_within_a_limit(spark, d):
    """Files of a size at most; a document without a text has none."""
    out = folder(spark, "limited")
    sinks.write_files(table(spark, d, "documents").filter("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("document")), local(out))
    return readers.glob_scan(spark, out, max_bytes=2000).select(text.stem(F.col("path")).cast("long").alias("doc_id"), "length")


@query("SELECT 's' || item_id AS notice_id, '' AS file_path, CASE WHEN item_id % 2 = 0 THEN 'poster' ELSE '' END AS sample_type, CASE WHEN item_id % 2 = 0 THEN 'a|b' ELSE '' END AS features, '' AS note FROM benchmark")
def sample_file(spark, d):
    i, out = F.col("item_id"), folder(spark, "samples")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("s"), i.cast("string")).alias("notice_id"), F.when(i % 2 == 0, "poster").alias("sample_type"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("expected_features"))
    sinks.write_jsonl(rows, out, keep_nulls=False)
    s = readers.ocr_samples(spark, out)
    return s.withColumn("features", F.array_join("expected_features", "|")).drop("expected_features")


@query("""
SELECT conv_id, turn, x.name AS name, x.kind AS kind, x.value AS value FROM (SELECT conv_id, turn, unnest([
  {'name': 'condition', 'kind': 'str', 'value': 'm' || role}, {'name': 'rrf_k', 'kind': 'int', 'value': turn::VARCHAR}, {'name': 'retrieval.bm25_top_k', 'kind': 'int', 'value': (conv_id % 50)::VARCHAR},
  {'name': 'retrieval.deep.on', 'kind': 'bool', 'value': 'True'}, {'name': 'generation.temperature', 'kind': 'float', 'value': '0.' || (turn % 9 + 1)}]) AS x FROM conversations)""")
def settings_values(spark, d):
    """What settings files say, one of each turn."""
    t = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("# c\ncondition: 'm"), "role", F.lit("'\nrrf_k: "), t("turn"), F.lit("\nretrieval:\n  bm25_top_k: "), (F.col("conv_id") % 50).cast("string"), F.lit("\n  deep:\n    on: true\n  list:\n    - a\ngeneration:\n  temperature: 0."), (F.col("turn") % 9 + 1).cast("string"), F.lit("\n"))
    return readers.setting_rows(table(spark, d, "conversations").select("conv_id", "turn", text.alias("settings")), "settings")


@query(f"SELECT DISTINCT unnest({_DATES}) AS found, 'date' AS kind FROM documents UNION SELECT DISTINCT unnest(list_concat({_PHONES}, {_MAILS})), 'contact' FROM documents")
def corpus_dates_and_contacts(spark, d):
    """What a corpus's metadata names, over all documents."""
    t = table(spark, d, "documents")
    return layout.found_values(t.select(layout.dates(F.col("text")).alias("extracted_dates"), layout.contacts(F.col("text")).alias("extracted_contacts")))


COMPARED = f"""
WITH {_SNIPPETS}, f AS (SELECT query_id, snippet, min(rank) AS rank FROM sn GROUP BY ALL),
k AS (SELECT *, coalesce(sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f),
an AS (SELECT query_id, substr(string_agg(snippet, chr(10) || chr(10) ORDER BY rank), 1, 512) AS answer FROM k WHERE used < 512 GROUP BY query_id),
pt AS (SELECT query_id, flatten(list({sql_tokens('alnum', 'text')}) FILTER (hybrid_rank <= 3)) AS t, max(coalesce(dense_score, 0)) AS best, string_agg(id, ',' ORDER BY hybrid_rank) AS ids, arg_min(document_id, hybrid_rank)::VARCHAR AS top1 FROM hy JOIN chunk USING (id) GROUP BY query_id),
ro AS (SELECT query_id, best, ids, top1, len(list_filter(q.q, lambda x: list_contains(t, x))) AS overlap, len(q.q) AS n FROM q JOIN pt USING (query_id)),
rf AS (SELECT *, CASE WHEN overlap < 1 THEN 'LOW_TOKEN_OVERLAP' WHEN overlap / greatest(n, 1) < 0.3 AND best < 0.22 THEN 'LOW_EVIDENCE_COVERAGE' ELSE '' END AS reason FROM ro)
SELECT query_id AS question_id, method, CASE WHEN reason <> '' THEN '{defaults.OFFLINE_REFUSAL_MESSAGE}' ELSE answer END AS answer, top1 AS top1_notice_id, ids AS chunk_ids, reason <> '' AS refusal, reason AS refusal_reason
FROM rf LEFT JOIN an USING (query_id), (VALUES ('text_only'), ('ocr_plain')) m(method)"""

#: SQL for queries of the first module that need what is defined here.
SQL |= {"html_visible_text": VISIBLE, "rate_limit_decisions": RATE, "stream_admissions": RATE, "reindex_cooldown": COOLDOWN, "demo_answer": DEMO, "layout_documents": LAYOUT, "collect_notices": NOTICES, "compare_results": COMPARED, "chat_answers": CHAT + " SELECT query_id, status, answer FROM chat"}
SQL["content_types"] = f"""
WITH v AS ({VISIBLE})
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'text' WHEN length(trim(replace(text, chr(10), ' '))) >= 120 OR page_id % 4 = 2 THEN 'mixed' WHEN page_id % 4 = 0 THEN 'image' ELSE 'pdf' END AS content_type FROM v"""
