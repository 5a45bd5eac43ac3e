"""Queries of the engine's own operators over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import defaults
from .functions import numbers, text, tokenizers, vectors
from .operators import admission, answers, cells, chunks, containment, dense, evidence, fusion, layout, lexical, metrics, postings, provenance, web
from .plans import search
from .session import spread
from .streaming import events
from .tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(t) if name in ("documents", "pages") else t


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_table(table(spark, d, "documents"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


# -- text

NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def norm(c: str) -> str:
    return NORM.format(c)


@query(f"SELECT doc_id, {norm('text')} AS text FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))


#: The test texts have neither headings nor blank lines, so each is one paragraph of one section.
CHUNKS = f"""
n AS (SELECT doc_id, {norm('text')} AS t FROM documents),
chunk AS MATERIALIZED (
  SELECT doc_id AS document_id, i AS chunk_index, doc_id || ':' || i AS id, regexp_replace(CASE WHEN length(t) <= 700 THEN t ELSE substr(t, i * 620 + 1, 620) END, '^\\s+|\\s+$', '', 'g') AS text
  FROM (SELECT doc_id, t, unnest(range(CASE WHEN t = '' THEN 0 WHEN length(t) <= 700 THEN 1 ELSE (length(t) + 619) // 620 END)) AS i FROM n))"""


@query(f"WITH {CHUNKS} SELECT document_id, chunk_index::INT AS chunk_index, id AS chunk_id, 'Document' AS section, text FROM chunk")
def chunk_fixed_split(spark, d):
    return _chunks(spark, d)


@query(f"SELECT doc_id AS document_id, 0 AS section_index, 'Document' AS section, {norm('text')} AS text FROM documents WHERE {norm('text')} <> ''")
def section_split(spark, d):
    return chunks.section_table(table(spark, d, "documents"))


@query(f"WITH {CHUNKS} SELECT count(*)::BIGINT AS chunk_count FROM chunk")
def planned_chunks(spark, d):
    return chunks.planned_chunk_count(table(spark, d, "documents"))


_ONE, _MORE = "|".join(tokenizers.SUFFIXES), "|".join(tokenizers.MORE_SUFFIXES)
_STRIP = lambda t, s: f"regexp_replace({t}, '^(..+?)(?:{s})$', '\\1')"
_SPLIT = r"regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+')"


def sql_tokens(kind: str, c: str) -> str:
    pieces = _SPLIT.format(c)
    if kind == "unicode":
        return f"list_filter(list_transform({pieces}, lambda t: {_STRIP('t', _ONE)}), lambda t: length(t) >= 2)"
    if kind == "evidence":
        return f"list_distinct(list_transform(list_filter({pieces}, lambda t: length(t) >= 2), lambda t: {_STRIP('t', _MORE)}))"
    if kind == "guard":
        return f"list_distinct(list_concat({sql_tokens('evidence', c)}, list_filter({pieces}, lambda t: length(t) >= 2)))"
    if kind == "whitespace":
        return rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda t: length(t) >= 2)"
    return f"list_transform(regexp_extract_all({c}, '[0-9A-Za-z가-힣]+'), lambda t: lower(t))"


def _tokens(kind: str, f, ordered: bool):
    def run(spark, d):
        t = table(spark, d, "documents").select("doc_id", f(F.col("text")).alias("t"))
        return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t" if ordered else F.array_sort("t"), " "), 256).alias("tokens_sha256"))

    run.__name__ = f"tokens_{kind}"
    t = sql_tokens(kind, "text")
    query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string({'t' if ordered else 'list_sort(t)'}, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {t} AS t FROM documents)")(run)


_tokens("unicode", tokenizers.unicode_tokens, True)
_tokens("alnum", tokenizers.alnum_tokens, True)
_tokens("whitespace", tokenizers.whitespace_tokens, True)
_tokens("evidence", tokenizers.evidence_tokens, False)
_tokens("guard", tokenizers.guard_tokens, False)


@query(r"""
SELECT doc_id, regexp_replace(substr(trim(regexp_replace(source || ' / ' || lang, '\s+', ' ', 'g')), 1, 80), ' /$', '') AS title, source || ' / ' || (doc_id % 7) || 'p / ' || lang AS label,
  CASE WHEN length(f) > 180 THEN substr(f, 1, 180) || '...' ELSE f END AS snippet,
  coalesce(nullif(regexp_replace(regexp_replace(text, '[^0-9A-Za-z가-힣_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS filename
FROM (SELECT *, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS f FROM documents)""")
def source_labels(spark, d):
    c = F.col
    return table(spark, d, "documents").select(
        "doc_id", text.summarize_title(c("source"), c("lang")).alias("title"), text.source_label(c("source"), c("doc_id") % 7, c("lang")).alias("label"),
        text.snippet(c("text")).alias("snippet"), text.safe_filename(F.col("text")).alias("filename"))


@query(r"""
SELECT doc_id, source AS title, lang, length(text) AS body_chars, 3 AS n_keys FROM documents""")
def front_matter(spark, d):
    raw = F.concat(F.lit('---\ntitle: "'), "source", F.lit('"\nlang: '), "lang", F.lit("\nno key here\nofficial: TRUE\n---"), "text")
    t = table(spark, d, "documents").select("doc_id", text.front_matter(raw).alias("f"))
    return t.select("doc_id", F.col("f.metadata")["title"].alias("title"), F.col("f.metadata")["lang"].alias("lang"), F.length("f.body").cast("long").alias("body_chars"), F.size("f.metadata").alias("n_keys"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i), ' ')) AS words_sha256 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def ordered_unique_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(text.ordered_unique(F.split("text", " ")), " "), 256).alias("words_sha256"))


# -- lexical search

_TF = f"tok AS MATERIALIZED (SELECT id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, {{0}} AS t FROM chunk)), tf AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM tok GROUP BY id, term)"
_STATS = "st AS (SELECT count(*) AS n, sum(dl) AS total, avg(dl) AS avgdl, count(DISTINCT document_id) AS documents FROM (SELECT document_id, len({0}) AS dl FROM chunk))"
_ALNUM, _UNI = sql_tokens("alnum", "text"), sql_tokens("unicode", "text")


@query(f"WITH {CHUNKS}, {_TF.format(_ALNUM)} SELECT id, term, tf::BIGINT AS tf, dl::BIGINT AS dl FROM tf")
def term_frequency(spark, d):
    return lexical.term_frequency(_chunks(spark, d), "chunk_id", "text")


@query(f"WITH {CHUNKS}, {_TF.format(_ALNUM)} SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term")
def document_frequency(spark, d):
    return lexical.document_frequency(lexical.term_frequency(_chunks(spark, d), "chunk_id", "text"))


@query(f"WITH {CHUNKS}, {_STATS.format(_ALNUM)} SELECT n::BIGINT AS n, total::BIGINT AS total_tokens, round(avgdl, 6) AS avgdl, documents::BIGINT AS documents FROM st")
def corpus_stats(spark, d):
    s = lexical.corpus_stats(_chunks(spark, d), "chunk_id", "text", document_col="document_id")
    return s.select("n", "total_tokens", F.round("avgdl", 6).alias("avgdl"), "documents")


def _bm25_sql(kind: str) -> str:
    weight = "count(*)" if kind == "alnum" else "1"
    return f"""{_TF.format(sql_tokens(kind, "text"))}, {_STATS.format(sql_tokens(kind, "text"))},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bq AS (SELECT query_id, term, {weight} AS w FROM (SELECT item_id AS query_id, unnest({sql_tokens(kind, "text")}) AS term FROM benchmark) GROUP BY query_id, term),
sc AS (SELECT query_id, id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, id),
bm AS MATERIALIZED (SELECT query_id, id, score AS bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS bm25_rank FROM sc QUALIFY bm25_rank <= 50)"""


@query(f"WITH {CHUNKS}, {_bm25_sql('alnum')} SELECT query_id, id, round(bm25_score, 6) AS bm25_score, bm25_rank::INT AS bm25_rank FROM bm")
def bm25_topk_offline(spark, d):
    ix = lexical.build_index(_chunks(spark, d), profile="offline")
    return lexical.search(ix, _questions(spark, d), 50).withColumn("bm25_score", F.round("bm25_score", 6))


@query(f"WITH {CHUNKS}, {_bm25_sql('unicode')} SELECT query_id, id, round(bm25_score, 6) AS bm25_score, bm25_rank::INT AS bm25_rank FROM bm")
def bm25_topk_online(spark, d):
    ix = lexical.build_index(_chunks(spark, d), profile="online")
    return lexical.search(ix, _questions(spark, d), 50).withColumn("bm25_score", F.round("bm25_score", 6))


@query(SQL["bm25_topk_offline"])
def bm25_topk_postings(spark, d):
    """The same from posting lists in blocks, most of which are skipped."""
    ix = postings.build(_chunks(spark, d), profile="offline")
    return postings.search(ix, _questions(spark, d), 50).withColumn("bm25_score", F.round("bm25_score", 6))


# -- vectors


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "embedding", "label"), v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = "SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"


@query(f"SELECT query_id, id, round(s, 5) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id)::INT AS dense_rank FROM ({_COS}) QUALIFY dense_rank <= 10")
def dense_topk(spark, d):
    v, q = _vectors(spark, d)
    return dense.search(v, q, 10).withColumn("dense_score", F.round("dense_score", 5))


@query(SQL["dense_topk"])
def dense_topk_cells(spark, d):
    """The same from cells, as far as bounds on angles don't rule them out."""
    v, q = _vectors(spark, d)
    return cells.search(cells.build(v), q, 10)[0].withColumn("dense_score", F.round("dense_score", 5))


@query(f"SELECT query_id, id, round(s, 4) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id)::INT AS dense_rank FROM ({_COS}) QUALIFY dense_rank <= 10")
def dense_topk_expression(spark, d):
    v, q = _vectors(spark, d)
    return dense.search_by_expression(v, q, 10, places=6).withColumn("dense_score", F.round("dense_score", 4))


@query(f"SELECT query_id, label, id, round(s, 5) AS dense_score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(s, 9) DESC, id) AS k FROM ({_COS})) WHERE k <= 3")
def dense_topk_per_label(spark, d):
    v, q = _vectors(spark, d)
    return dense.search_by_group(v, q, 3, "label").select("query_id", "label", "id", F.round("dense_score", 5).alias("dense_score"), F.col("dense_rank").alias("k"))


_SHA_BUCKET = "(('0x' || substr(sha256(term), 1, 8))::UBIGINT % 256)::BIGINT"
_SHA_SIGN = "CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END"


def _embed_sql(src: str, id_: str, name: str) -> str:
    return f"""{name}w AS (SELECT {id_} AS id, {_SHA_BUCKET} AS bucket, sum({_SHA_SIGN})::DOUBLE AS w FROM (SELECT {id_}, unnest({_ALNUM}) AS term FROM {src}) GROUP BY ALL HAVING w <> 0),
{name} AS MATERIALIZED (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}w)"""


@query(f"WITH {_embed_sql('documents', 'doc_id', 'e')} SELECT id, bucket, round(weight, 6) AS weight FROM e")
def hashed_embedding_sha(spark, d):
    return vectors.sparse_embedding(table(spark, d, "documents"), "doc_id", "text", "offline").withColumn("weight", F.round("weight", 6))


_JAVA = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"


@query(f"""
WITH t AS (SELECT doc_id AS id, unnest({sql_tokens('evidence', 'text')}) AS term FROM documents),
h AS (SELECT id, {_JAVA} AS h FROM t), b AS (SELECT id, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 256 + 256) % 256 AS bucket FROM h),
w AS (SELECT id, bucket, count(*)::DOUBLE AS w FROM b GROUP BY ALL)
SELECT id, bucket::BIGINT AS bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def hashed_embedding_javahash(spark, d):
    return vectors.sparse_embedding(table(spark, d, "documents"), "doc_id", "text", "online").select("id", "bucket", F.round("weight", 6).alias("weight"))


# -- hybrid search and what follows from it

HYBRID = f"""{CHUNKS}, {_bm25_sql('alnum')}, {_embed_sql('chunk', 'id', 'cv')}, {_embed_sql('benchmark', 'item_id', 'qv')},
dn0 AS (SELECT b.item_id AS query_id, c.id FROM benchmark b, chunk c),
dot AS (SELECT q.id AS query_id, c.id, sum(q.weight * c.weight) AS s FROM qv q JOIN cv c USING (bucket) GROUP BY ALL),
dn AS MATERIALIZED (SELECT query_id, id, coalesce(s, 0) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, id) AS dense_rank FROM dn0 LEFT JOIN dot USING (query_id, id) QUALIFY dense_rank <= 50),
hy0 AS (SELECT query_id, id, bm25_score, dense_score, bm25_rank, dense_rank, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS hybrid_score FROM bm FULL JOIN dn USING (query_id, id)),
hy AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 12) DESC, bm25_rank NULLS LAST, dense_rank) AS hybrid_rank FROM hy0 QUALIFY hybrid_rank <= 5)"""


def _hybrid(spark, d):
    return search.hybrid(search.build(_chunks(spark, d)), _questions(spark, d))


@query(f"WITH {HYBRID} SELECT query_id, id, round(bm25_score, 6) AS bm25_score, round(dense_score, 6) AS dense_score, bm25_rank::INT AS bm25_rank, dense_rank::INT AS dense_rank, round(hybrid_score, 9) AS hybrid_score, hybrid_rank::INT AS hybrid_rank FROM hy")
def hybrid_rrf_topk(spark, d):
    h = _hybrid(spark, d)
    return h.select("query_id", "id", F.round("bm25_score", 6).alias("bm25_score"), F.round("dense_score", 6).alias("dense_score"), "bm25_rank", "dense_rank", F.round("hybrid_score", 9).alias("hybrid_score"), "hybrid_rank")


def _ranked(spark, d):
    ix = search.build(_chunks(spark, d))
    return search.hybrid(ix, _questions(spark, d)).join(ix.chunks.select("id", "document_id", "text"), "id").withColumnRenamed("hybrid_rank", "rank")


@query(f"""
WITH {HYBRID},
q AS (SELECT item_id AS query_id, list_distinct({_ALNUM}) AS q FROM benchmark),
p AS (SELECT query_id, flatten(list({_ALNUM}) FILTER (hybrid_rank <= 3)) AS t, max(coalesce(dense_score, 0)) AS best FROM hy JOIN chunk USING (id) GROUP BY query_id),
o AS (SELECT query_id, best, len(list_filter(q, lambda x: list_contains(t, x))) AS overlap, len(q) AS n FROM q JOIN p USING (query_id))
SELECT query_id, reason <> '' AS refusal, reason AS refusal_reason, overlap::INT AS overlap, round(overlap / greatest(n, 1), 6) AS coverage
FROM (SELECT *, CASE WHEN overlap < 1 THEN 'LOW_TOKEN_OVERLAP' WHEN overlap / greatest(n, 1) < 0.3 AND best < 0.22 THEN 'LOW_EVIDENCE_COVERAGE' ELSE '' END AS reason FROM o)""")
def refusal_offline(spark, d):
    return evidence.refusal_offline(_questions(spark, d), _ranked(spark, d).select("query_id", "rank", "text", "dense_score")).withColumn("coverage", F.round("coverage", 6))


def _retrieved(spark, d):
    """The five best chunks of each question by BM25, with a score that stands for similarity."""
    c = stored(_chunks(spark, d), "chunks")
    r = lexical.search(lexical.build_index(c, profile="offline"), _questions(spark, d), 5).join(c.select(F.col("chunk_id").alias("id"), "document_id", "text"), "id")
    return stored(r.select("query_id", "id", F.concat(F.lit("doc "), F.col("document_id").cast("string")).alias("title"), F.lit("Document").alias("section"), F.col("text").alias("content"), (F.lit(0.9) - F.col("bm25_rank") * 0.15).alias("dense_score")), "retrieved")


_RETRIEVED = f"""{CHUNKS}, {_bm25_sql('alnum')},
ret AS MATERIALIZED (SELECT query_id, id, 'doc ' || document_id AS title, 'Document' AS section, text AS content, 0.9::DOUBLE - bm25_rank * 0.15::DOUBLE AS dense_score FROM bm JOIN chunk USING (id) WHERE bm25_rank <= 5)"""
_SEARCHABLE = "title || ' ' || section || ' ' || content"
_GUARDED = f"""g AS (SELECT item_id AS query_id, text AS question, {sql_tokens('guard', 'text')} AS q FROM benchmark),
ov AS MATERIALIZED (SELECT query_id, id, dense_score, len(list_filter(q, lambda x: list_contains(t, x))) AS overlap, len(q) AS n FROM (SELECT r.*, g.q, {sql_tokens('guard', _SEARCHABLE)} AS t FROM ret r JOIN g USING (query_id)))"""
_CUES = " OR ".join(f"contains(lower(question), '{c}')" for c in defaults.HARD_CUES)


@query(f"""
WITH {_RETRIEVED}, {_GUARDED},
b AS (SELECT query_id, max(dense_score) AS top, max(overlap) AS overlap, any_value(n) AS n, max((overlap >= 1 AND overlap / n >= 0.3)::INT) AS relevant FROM ov GROUP BY query_id)
SELECT query_id, question, status, status = 'MATCHED' AS allowed, round(coalesce(top, 0), 6) AS top_dense_score, coalesce(overlap, 0)::INT AS overlap, round(coalesce(overlap / n, 0), 6) AS coverage
FROM (SELECT *, CASE WHEN top IS NULL THEN 'NO_RETRIEVAL' WHEN top < 0.22 THEN 'LOW_DENSE_SCORE' WHEN ({_CUES}) AND overlap / n < 1 THEN 'OUT_OF_DOMAIN_CUE' WHEN relevant = 0 THEN 'LOW_LEXICAL_RELEVANCE' ELSE 'MATCHED' END AS status FROM g LEFT JOIN b USING (query_id))""")
def refusal_online(spark, d):
    out = evidence.refusal_online(_questions(spark, d), _retrieved(spark, d))[0]
    return out.withColumn("top_dense_score", F.round("top_dense_score", 6)).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT conv_id, turn, ({_CUES}) AS cue FROM (SELECT conv_id, turn, text || CASE WHEN turn % 5 = 0 THEN ' 오늘 날씨' ELSE '' END AS question FROM conversations)")
def ood_cue(spark, d):
    q = F.concat("text", F.when(F.col("turn") % 5 == 0, F.lit(" 오늘 날씨")).otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", evidence.has_cue(q).alias("cue"))


_RERANKED = f"""{_RETRIEVED},
e AS (SELECT item_id AS query_id, {sql_tokens('evidence', 'text')} AS q FROM benchmark),
rr0 AS (SELECT query_id, id, content, dense_score AS similarity, len(list_filter(q, lambda x: list_contains(t, x))) AS overlap FROM (SELECT r.*, e.q, {sql_tokens('evidence', _SEARCHABLE)} AS t FROM ret r JOIN e USING (query_id))),
rr AS MATERIALIZED (SELECT *, overlap * 10.0::DOUBLE + similarity AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY overlap * 10.0::DOUBLE + similarity DESC, similarity DESC, id) AS rank FROM rr0 WHERE similarity >= 0.18 OR overlap > 0)"""


def _reranked(spark, d):
    return answers.rerank(_questions(spark, d), _retrieved(spark, d).withColumnRenamed("dense_score", "similarity"))


@query(f"WITH {_RERANKED} SELECT query_id, id, overlap::INT AS overlap, round(rank_score, 6) AS rank_score, rank::INT AS rank FROM rr")
def rerank_lexical(spark, d):
    return _reranked(spark, d).select("query_id", "id", "overlap", F.round("rank_score", 6).alias("rank_score"), "rank")


@query(f"WITH {_RERANKED} SELECT query_id, id, rank::INT AS rank, used::BIGINT AS used_chars FROM (SELECT *, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM rr) WHERE used <= 1500 OR rank = 1")
def context_budget(spark, d):
    return answers.context_budget(_reranked(spark, d), 1500).select("query_id", "id", "rank", "used_chars")


_SENTENCE = r"regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+')"
_SNIPPETS = f"""{HYBRID},
q AS (SELECT item_id AS query_id, list_distinct({_ALNUM}) AS q FROM benchmark),
sn0 AS (SELECT query_id, hybrid_rank AS rank, q, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM (SELECT query_id, hybrid_rank, {_SENTENCE} AS s FROM hy JOIN chunk USING (id)) JOIN q USING (query_id)),
sn1 AS (SELECT query_id, rank, pos, {norm('s')} AS s, q FROM sn0),
sn AS MATERIALIZED (SELECT query_id, rank, substr(s, 1, 500) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY len(list_filter(q, lambda x: list_contains({sql_tokens('alnum', 's')}, x))) DESC, pos) AS k FROM sn1 WHERE s <> '') WHERE k = 1)"""


@query(f"WITH {_SNIPPETS} SELECT query_id, rank::INT AS rank, snippet FROM sn")
def best_snippet(spark, d):
    return answers.best_snippet(_questions(spark, d), _ranked(spark, d))


@query(f"""
WITH {_SNIPPETS}, f AS (SELECT query_id, snippet, min(rank) AS rank FROM sn GROUP BY ALL),
k AS (SELECT *, coalesce(sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
SELECT query_id, substr(string_agg(snippet, chr(10) || chr(10) ORDER BY rank), 1, 512) AS answer FROM k WHERE used < 512 GROUP BY query_id""")
def extractive_answer(spark, d):
    q = _questions(spark, d)
    return answers.compose(q, _ranked(spark, d), q.select("query_id", F.lit(False).alias("refusal")))


def _chat(spark, d):
    r = _retrieved(spark, d).withColumn("page", F.lit(None).cast("int")).withColumn("url", F.lit("")).withColumn("posted_at", F.lit(None).cast("timestamp"))
    return answers.chat(_questions(spark, d), r).drop("prompt")


@query()
def chat_answers(spark, d):
    return _chat(spark, d).drop("sources")


@query()
def demo_answer(spark, d):
    r = _reranked(spark, d)
    return answers.compose_demo(_questions(spark, d), r.select("query_id", "rank", "content", "similarity"))


# -- evaluation

_GOLD = "gold AS (SELECT b.item_id AS query_id, coalesce(min(d.doc_id)::VARCHAR, '') AS gold FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"
_RESULTS = f"""{HYBRID}, {_GOLD},
ids AS (SELECT query_id, list(document_id::VARCHAR ORDER BY r) AS ids FROM (SELECT query_id, document_id, min(hybrid_rank) AS r FROM hy JOIN chunk USING (id) GROUP BY ALL) GROUP BY query_id),
res AS MATERIALIZED (SELECT query_id, gold, coalesce(ids, []) AS ids, query_id % 2 = 0 AS refusal, query_id * 1.5 AS ms, CASE query_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS category FROM gold LEFT JOIN ids USING (query_id))"""


def _results(spark, d):
    q, docs = _questions(spark, d), table(spark, d, "documents")
    hits = containment.containing(docs.select(F.col("doc_id").alias("id"), "text"), q)
    gold = q.join(hits.groupBy("query_id").agg(F.min("id").alias("g")), "query_id", "left").select("query_id", F.coalesce(F.col("g").cast("string"), F.lit("")).alias("gold_notice_id"))
    ids = _ranked(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("document_id").cast("string").alias("i")))), lambda x: x["i"]).alias("ids")).select("query_id", F.array_distinct("ids").alias("retrieved_notice_ids"))
    out = gold.join(ids, "query_id", "left")
    k = F.col("query_id") % 3
    return out.select(F.lit("text_only").alias("method"), F.when(k == 0, "a").when(k == 1, "b").otherwise("").alias("category"), "gold_notice_id", "retrieved_notice_ids", (F.col("query_id") % 2 == 0).alias("refusal"), (F.col("query_id") * 1.5).alias("latency_ms"), "query_id")


@query(f"""
WITH {_RESULTS},
per AS (SELECT 'text_only' AS method, category, gold <> '' AS known, list_position(ids, gold) AS p, refusal, ms FROM res),
m AS (SELECT method, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS subset, grouping(category) AS g, category,
  avg((p <= 1)::INT) FILTER (known) AS r1, avg(coalesce(p <= 3, false)::INT) FILTER (known) AS r3, avg(coalesce(p <= 5, false)::INT) FILTER (known) AS r5,
  avg(coalesce(p <= 1, false)::INT) FILTER (known) AS h1, avg(coalesce(1.0::DOUBLE / nullif(p, 0), 0)) FILTER (known) AS mrr,
  avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1.0::DOUBLE / log2(p + 1) ELSE 0 END) FILTER (known) AS nd, avg(refusal::INT) FILTER (NOT known) AS rf, avg(ms) AS ms
  FROM per GROUP BY GROUPING SETS ((method), (method, category)))
SELECT method, subset, round(h1, 6) AS recall_at_1, round(r3, 6) AS recall_at_3, round(r5, 6) AS recall_at_5, round(mrr, 6) AS mrr, round(nd, 6) AS ndcg_at_5, round(rf, 6) AS refusal_accuracy, round(ms::DOUBLE, 6) AS avg_latency_ms
FROM m WHERE g = 1 OR category <> ''""")
def ir_metrics(spark, d):
    return metrics.ir_metrics(_results(spark, d))


@query("SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark, d):
    return containment.containing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _questions(spark, d))


@query(f"""
WITH {HYBRID}, m(method, rrf_k) AS (VALUES ('k60', 60), ('k10', 10)),
h AS (SELECT method, query_id, id, row_number() OVER (PARTITION BY method, query_id ORDER BY round(coalesce(1.0::DOUBLE / (rrf_k + bm25_rank), 0) + coalesce(1.0::DOUBLE / (rrf_k + dense_rank), 0), 12) DESC, bm25_rank NULLS LAST, dense_rank) AS k FROM hy0, m QUALIFY k <= 5)
SELECT method, query_id, id, k::INT AS hybrid_rank FROM h""")
def compare_rankings(spark, d):
    ix = search.build(_chunks(spark, d))
    q = _questions(spark, d)
    a, b = lexical.search(ix.bm25, q, 50), dense.search(ix.vectors, search.query_vectors(q, "offline", 256), 50, 256, normalised=True)
    runs = [fusion.rrf(a, b, 5, k).select(F.lit(f"k{k}").alias("method"), "query_id", "id", "hybrid_rank") for k in (60, 10)]
    return runs[0].unionByName(runs[1])


@query()
def compare_results(spark, d):
    """The comparison of two methods, the chunks of each answer as their ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang", "text")
    docs = docs.select("document_id", F.col("source").alias("title"), F.lit("").alias("path"), F.lit("").alias("url"), F.lit(None).cast("string").alias("posted_at"), F.lit("text").alias("content_type"), F.create_map(F.lit("notice_id"), F.col("document_id")).alias("metadata"), "text")
    q = _questions(spark, d).withColumn("category", F.lit("")).withColumn("important", F.lit(False)).withColumn("gold_notice_id", F.lit(""))
    ix = search.documents_index(docs)
    r = search.compare({"text_only": ix, "ocr_plain": ix}, q)
    return r.select("question_id", "method", "answer", "top1_notice_id", F.array_join(F.transform("retrieved_chunks", lambda c: c["chunk_id"]), ",").alias("chunk_ids"), "refusal", "refusal_reason")


# -- provenance


@query(r"SELECT sha256(string_agg(t || chr(0) || 'p' || chr(0) || 'text' || chr(0) || 'Document' || chr(0) || 'null' || chr(0) || text || chr(0), '' ORDER BY doc_id)) AS corpus_hash FROM (SELECT doc_id, 'doc ' || doc_id AS t, text FROM documents WHERE text IS NOT NULL)")
def corpus_hash(spark, d):
    b = table(spark, d, "documents").filter("text is not null")
    s = b.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("p").alias("path"), F.lit("text").alias("content_type"), F.lit(0).alias("section_index"), F.lit("Document").alias("section"), F.lit(None).cast("int").alias("page"), "text")
    return provenance.corpus_hash(s)


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_metadata(spark, d):
    return provenance.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


_META = "c_mktsegment AS index_name, 'v1' AS index_version"


@query("""
WITH e AS (SELECT c_mktsegment AS index_name, count(*) AS n, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY ALL)
SELECT index_name, 'v1' AS index_version, r <> 'INDEX_UP_TO_DATE' AS reindex_required, r AS reason FROM (SELECT index_name, CASE index_name WHEN 'BUILDING' THEN 'METADATA_MISSING' WHEN 'MACHINERY' THEN 'KNOWLEDGE_BASE_EMPTY' WHEN 'HOUSEHOLD' THEN 'CHUNK_COUNT_CHANGED' WHEN 'FURNITURE' THEN 'TOKENIZER_CHANGED' ELSE 'INDEX_UP_TO_DATE' END AS r FROM e)""")
def reindex_decision(spark, d):
    c = table(spark, d, "customer")
    e = c.groupBy(F.col("c_mktsegment").alias("index_name"), F.lit("v1").alias("index_version")).agg(F.count("*").alias("document_count"), F.countDistinct("c_nationkey").alias("chunk_count"))
    same = {"corpus_hash": "h", "embedding_model": "hashed-256", "embedding_dim": 256, "chunk_size": 700, "chunk_overlap": 0, "tokenizer": "t", "retrieval_config_hash": "r", "source_data_path": "p"}
    for k, v in same.items():
        e = e.withColumn(k, F.lit(v))
    old = e.filter("index_name <> 'BUILDING'").withColumn("chunk_count", F.when(F.col("index_name") == "HOUSEHOLD", F.col("chunk_count") + 1).otherwise(F.col("chunk_count"))).withColumn("tokenizer", F.when(F.col("index_name") == "FURNITURE", "other").otherwise(F.col("tokenizer")))
    older = old.withColumn("corpus_hash", F.lit("old")).withColumn("id", F.lit(1))
    stored = older.unionByName(old.withColumn("id", F.lit(2)))
    kb = e.select("index_name", "index_version", F.lit(1).alias("documents"), F.lit(1).alias("chunks"), F.when(F.col("index_name") == "MACHINERY", 0).otherwise(1).alias("embeddings"))
    return provenance.reindex_decision(e, stored, kb)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows FROM {t}" for t in ("documents", "pages", "events", "embeddings")))
def status_counts(spark, d):
    return provenance.row_counts(**{t: table(spark, d, t) for t in ("documents", "pages", "events", "embeddings")})


# -- web pages

_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_CLEAN = _TITLE
for _a, _b in ((r"(?i)</?(p|div|li|br|tr|td|th|h1|h2|h3|h4|section|article)\b[^>]*>", "chr(10)"), ("<[^>]*>", "''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_a}', {_b}, 'g')"
_CLEAN = rf"regexp_replace(regexp_replace({_CLEAN}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, coalesce(nullif({_CLEAN}, ''), '{web.NO_TITLE}') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


_PATH = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_URL = "CASE WHEN page_id % 3 = 0 THEN 'https://x.example.org/main/boardview/' || (page_id % 9 + 18) || '/' || page_id ELSE url END"


@query(rf"""
SELECT page_id, CASE WHEN v <> '' THEN 'main_' || v || '_' || page_id ELSE 'notice_' || substr(sha256(u), 1, 12) END AS notice_id,
  CASE v WHEN '19' THEN '입학 공지사항' WHEN '' THEN '공지' ELSE '게시판 ' || v END AS category,
  regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS department
FROM (SELECT page_id, u, regexp_extract({_PATH.format('u')}, '/boardview/(\d+)/', 1) AS v FROM (SELECT page_id, {_URL} AS u FROM pages))""")
def url_notice_id(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.example.org/main/boardview/"), (F.col("page_id") % 9 + 18).cast("string"), F.lit("/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", web.notice_id(u).alias("notice_id"), web.category_of(u, {"19": "입학 공지사항"}).alias("category"), web.department_of(u, []).alias("department"))


@query(r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN printf('%04d-%02d-%02dT%02d:%02d:00+09:00', 2020 + page_id % 5, 1 + page_id % 12, 1 + page_id % 28, page_id % 24, page_id % 60) END AS posted_at FROM pages""")
def posted_at(spark, d):
    """Whole pages, of which every other one has the label put before its html."""
    p = F.col("page_id")
    stamp = F.format_string("<div id='IContents_span작성일시'><p>x %d.%d.%d %d:%02d</p></div>", 2020 + p % 5, 1 + p % 12, 1 + p % 28, p % 24, p % 60)
    return table(spark, d, "pages").select("page_id", web.posted_at(F.concat(F.when(p % 2 == 0, stamp).otherwise(""), "html")).alias("posted_at"))


@query()
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", web.content_text(F.col("html")).alias("text"))


@query()
def collect_notices(spark, d):
    """The manifest of all pages, files as one text."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", "html")
    return web.collect_notices(p).withColumn("attachment_urls", F.array_join("attachment_urls", " "))


@query()
def content_types(spark, d):
    k = F.col("page_id") % 4
    files = F.when(k == 0, F.array(F.lit("http://a/x.PNG?y=1"))).when(k == 1, F.array(F.lit("http://a/x.pdf"))).when(k == 2, F.array(F.lit("http://a/b.jpeg"), F.lit("http://a/c.pdf#p"))).otherwise(F.array(F.lit("http://a/x.hwp")))
    return table(spark, d, "pages").select("page_id", web.content_type(web.content_text(F.col("html")), files).alias("content_type"))


@query("SELECT doc_id, first AS original, doc_id <> first AS is_duplicate FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def dup_first_wins(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    out = web.mark_duplicates(t, order="doc_id", id_col="doc_id")
    return out.select("doc_id", F.coalesce("duplicate_of", "doc_id").alias("original"), "is_duplicate")


@query("""
WITH f AS (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 AS dup FROM pages), k(content_type, i) AS (VALUES ('text', 0), ('image', 1), ('pdf', 2), ('mixed', 3))
SELECT content_type, count(*) FILTER (page_id % 3 = i AND NOT dup)::BIGINT AS n FROM k, f GROUP BY content_type""")
def content_type_counts(spark, d):
    p = table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("source_hash"), F.col("page_id").alias("notice_id"), F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("pdf")), (F.col("page_id") % 3 + 1).cast("int")).alias("content_type"))
    return web.content_type_counts(web.mark_duplicates(p, order="page_id"))


# -- recognised pages

_FIND = lambda c, p: f"list_filter(list_transform(regexp_extract_all({c}, '{p}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_DATES, _PHONES, _MAILS = (_FIND("text", p) for p in (layout.DATE, layout.PHONE, layout.EMAIL))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_DATES})), '|') AS dates, array_to_string(list_sort(list_distinct(list_concat({_PHONES}, {_MAILS}))), '|') AS contacts FROM documents")
def extract_dates_contacts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(layout.dates(F.col("text"))), "|").alias("dates"), F.array_join(F.array_sort(layout.contacts(F.col("text"))), "|").alias("contacts"))


def _ocr(spark, d):
    """Conversations as recognised pages: turns are blocks, the last one first."""
    c = table(spark, d, "conversations")
    t = F.col("turn").cast("double")
    b = F.struct(F.col("text"), F.array(F.lit(0.0), t * 10, F.lit(5.0), t * 10 + 5).alias("bbox"), (F.col("turn") % 4 / 4.0).alias("confidence"), F.lit(1).alias("page"), F.when(F.col("role") == "user", "title").otherwise("unknown").alias("block_type"))
    r = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), b.alias("b")))), lambda x: x["b"]).alias("blocks"))
    r = r.select(F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("notice_id"), F.lit("x.png").alias("file_path"), F.lit("engine").alias("ocr_engine"), F.lit("1").alias("engine_version"), F.lit("none").alias("preprocess_profile"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit(None).cast("string").alias("posted_at"), F.create_map().cast("map<string,string>").alias("metadata"), "blocks")
    m = c.select(F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("notice_id")).distinct().filter("notice_id <> 'n1'").select("notice_id", F.concat(F.lit("title "), "notice_id").alias("title"), F.lit("http://x").alias("url"), F.lit("2026").alias("posted_at"))
    return layout.layout_chunks(r, m)


_BLOCK = f"""
b AS (SELECT conv_id, turn, role, {norm('text')} AS text, turn % 4 / 4.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 10.0, turn DESC) AS reading_order FROM conversations),
bt AS MATERIALIZED (SELECT *, CASE WHEN role = 'user' THEN 'title' WHEN len({_PHONES}) + len({_MAILS}) > 0 THEN 'contact' WHEN len({_DATES}) > 0 AND length(text) <= 80 THEN 'date'
  WHEN (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 AND contains(text, '|')) OR len(regexp_extract_all(text, '\\s{{2,}}')) >= 3 THEN 'table' WHEN confidence <= 0 THEN 'unknown' ELSE 'body' END AS block_type FROM b WHERE text <> '')"""


@query(f"WITH {_BLOCK} SELECT 'layout_n' || conv_id || '_1_' || printf('%04d', reading_order) AS chunk_id, 'n' || conv_id AS notice_id, block_type, reading_order::INT AS reading_order, confidence, CASE WHEN conv_id = 1 THEN 'Layout-aware OCR - n1' ELSE 'title n' || conv_id END AS title, CASE WHEN conv_id <> 1 THEN 'http://x' END AS url, text FROM bt")
def layout_chunks(spark, d):
    return _ocr(spark, d).select("chunk_id", "notice_id", "block_type", "reading_order", "confidence", "title", "url", "text")


@query(f"WITH {_BLOCK}, k(block_type) AS (VALUES ('title'), ('body'), ('table'), ('date'), ('contact'), ('unknown')) SELECT k.block_type, count(bt.block_type)::BIGINT AS n FROM k LEFT JOIN bt USING (block_type) GROUP BY ALL")
def block_type_counts(spark, d):
    return layout.block_type_counts(_ocr(spark, d))


@query(f"WITH {_BLOCK} SELECT count(*)::BIGINT AS layout_chunk_count, count(*) FILTER (confidence < 0.5)::BIGINT AS low_confidence_chunk_count FROM bt")
def layout_metadata(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("text").alias("content_type"), F.lit(1).alias("chunk_count"))
    return layout.index_metadata(docs, _ocr(spark, d)).select("layout_chunk_count", "low_confidence_chunk_count")


@query()
def layout_documents(spark, d):
    return layout.chunk_document(_ocr(spark, d)).select("chunk_id", "document")


# -- numbers


@query("""
SELECT l_orderkey, l_linenumber, floor((i / 1000000.0::DOUBLE * CASE WHEN l_linenumber % 2 = 0 THEN 1.25::DOUBLE ELSE 0.25::DOUBLE END + o / 1000000.0::DOUBLE * CASE WHEN l_linenumber % 2 = 0 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END) * 1e9 + 0.5) / 1e9 AS usd
FROM (SELECT *, (l_quantity * 100)::INT AS i, CASE WHEN l_linenumber <> 7 THEN (l_quantity * 7)::INT END AS o FROM lineitem)""")
def cost_estimate(spark, d):
    o = F.when(F.col("l_linenumber") != 7, (F.col("l_quantity") * 7).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.estimate_usd((F.col("l_quantity") * 100).cast("int"), o, F.col("l_linenumber") % 2 == 0).alias("usd"))


@query("SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS rounded FROM customer")
def round_half_up(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.round_half_up(F.col("c_acctbal"), 1).alias("rounded"))


@query("""
SELECT p_partkey, CASE WHEN big >= 1600 THEN w ELSE ceil(w * (1600.0::DOUBLE / big))::INT END AS width, CASE WHEN big >= 1600 THEN h ELSE ceil(h * (1600.0::DOUBLE / big))::INT END AS height, CASE WHEN big >= 1600 THEN 'resize_skipped_long_side_' || big ELSE 'upscale_long_side_to_1600' END AS resize
FROM (SELECT *, greatest(w, h) AS big FROM (SELECT p_partkey, (p_size * 40)::INT AS w, (p_partkey % 50 * 40 + 1)::INT AS h FROM part))""")
def image_plan(spark, d):
    w, h = (F.col("p_size") * 40).cast("int"), (F.col("p_partkey") % 50 * 40 + 1).cast("int")
    p = table(spark, d, "part").select("p_partkey", numbers.preprocess_plan(w, h, F.lit("basic")).alias("p"))
    return p.select("p_partkey", "p.width", "p.height", F.get("p.operations", 1).alias("resize"))


@query("""
SELECT event_id, CASE user_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '9.9.9.9' WHEN 2 THEN '::1' ELSE '7.7.7.7' END AS ip FROM events""")
def client_ip(spark, d):
    k = F.col("user_id") % 4
    remote = F.when(k == 0, F.concat(F.lit("::ffff:10.0.0."), F.col("user_id").cast("string"))).otherwise("1.1.1.1")
    fwd = F.when(k == 0, "8.8.8.8").when(k == 1, " 9.9.9.9 , 1.2.3.4").when(k == 2, "0:0:0:0:0:0:0:1")
    return table(spark, d, "events").select("event_id", numbers.client_ip(remote, fwd, F.lit("7.7.7.7"), ["1.1.1.1"]).alias("ip"))


@query("SELECT conv_id, turn, length(text) > 500 OR trim(text) = '' AS rejected FROM conversations")
def request_validation(spark, d):
    from .sources.readers import valid_questions

    r = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("session_id"))
    ok, bad = valid_questions(r)
    return ok.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).select("conv_id", "turn", "rejected")


# -- requests and streams


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")).alias("ip"), F.col("user_id").cast("string").alias("session_id"))


@query()
def rate_limit_decisions(spark, d):
    s = defaults.Settings.of(ip_minute_limit=2, ip_daily_limit=30, session_minute_limit=1, session_daily_limit=4, rate_window_seconds=600)
    return admission.decide(_requests(spark, d), s).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query()
def reindex_cooldown(spark, d):
    return admission.cooldown(_requests(spark, d).withColumnRenamed("ip", "index_name"), 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return events.window_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM b GROUP BY user_id, s""")
def event_sessions(spark, d):
    s = events.session_counts(table(spark, d, "events"))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT user_id || event_type AS source_hash, min(ts) AS ts FROM events GROUP BY ALL")
def stream_first_wins(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", F.concat(F.col("user_id").cast("string"), "event_type").alias("source_hash"))
    return events.first_of_hash(e).select("source_hash", F.col("ts").cast("timestamp_ntz").alias("ts"))


# -- Spark's own relational operators, over the star schema: nothing here is the engine's


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def builtin_pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def builtin_star_join(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())")
def builtin_grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def builtin_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def builtin_set_operations(spark, d):
    t = lambda n: table(spark, d, n)
    a = t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))
    return a.exceptAll(t("nation").filter("n_regionkey = 1").select("n_nationkey")).distinct()
