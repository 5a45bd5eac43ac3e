"""Chunks, BM25, vectors, fusion, evidence, answers, metrics, provenance."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.defaults import Settings
from lodestone.operators import answers, chunks, dense, evidence, fusion, lexical, metrics, provenance
from lodestone.plans import search

c = F.col


A, B, C = "a", "b", "c"
#: Texts and their chunks, worked out by hand.
PACKED = [
    (A * 700, [A * 700]),
    (A * 701, [A * 620, A * 81]),
    (A * 1240, [A * 620, A * 620]),
    (f"{A * 179}\n\n{B * 600}", [f"{A * 179}\n\n{B * 600}"]),  # a short one takes the next, however long
    (f"{A * 180}\n\n{B * 600}", [A * 180, B * 600]),
    (f"{A * 180}\n\n{B * 518}", [f"{A * 180}\n\n{B * 518}"]),  # exactly the size
    (f"{A * 180}\n\n{B * 519}", [A * 180, B * 519]),
    (f"short\n \n{C * 701}", ["short", C * 620, C * 81]),
    (f"{A * 701}\n\n{B}\n\n{C}", [A * 620, A * 81, f"{B}\n\n{C}"]),
    (f"{A * 610}{' ' * 90}{B * 30}", [f"{A * 610} {B * 30}"]),
    (f"{A * 619} {B * 100}", [A * 619, B * 100]),  # a cut after white space leaves none
    ("a\r\n\r\nb\t\tc", ["a\n\nb c"]),
    ("", []),
    (" \n ", []),
]


def test_packing(spark):
    got = spark.createDataFrame(PACKED, "t string, want array<string>").select("want", chunks.chunks(c("t")).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_packing_loses_nothing(spark):
    rnd = random.Random(3)
    para = lambda n: ("가나 b" * n)[:n].strip()
    texts = ["\n\n".join(para(rnd.choice([1, 50, 179, 180, 181, 520, 600, 700, 701, 1500])) for _ in range(rnd.randrange(1, 8))) for _ in range(80)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks.chunks(c("t")).alias("c")).collect():
        assert "".join("".join(r.c).split()) == "".join(r.t.split())
        assert all(x == x.strip() and 0 < len(x) <= 179 + 2 + 700 for x in r.c)


def test_sections(spark):
    t = "intro\n# One \nbody\n\n####### no\n#x no\n## Two\n\n### Three\nlast\r\n#  \nend"
    got = spark.createDataFrame([(t,)], "t string").select(chunks.sections(c("t"), "Doc").alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [("Doc", "intro"), ("One", "body\n\n####### no\n#x no"), ("Three", "last"), ("", "end")]
    docs = spark.createDataFrame([(7, t), (8, None), (9, "")], "doc_id int, text string")
    rows = chunks.chunk_table(docs).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.section) for r in rows] == [("7:0", "Document"), ("7:1", "One"), ("7:2", "Three"), ("7:3", "")]
    assert chunks.planned_chunk_count(docs).first()[0] == 4


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("d1", "a b a"), ("d2", "b c"), ("d3", "c c c d"), ("d4", "...")], "chunk_id string, text string")


def test_bm25(spark, small):
    three = small.filter("chunk_id <> 'd4'")
    q = spark.createDataFrame([(1, "a b b"), (2, "zzz"), (3, "")], "query_id int, question string")
    ix = lexical.build_index(three)
    got = {(r.query_id, r.id): (round(r.bm25_score, 6), r.bm25_rank) for r in lexical.search(ix, q).collect()}
    assert got == {(1, "d1"): (2.341192, 1), (1, "d2"): (1.105891, 2)}
    assert sorted(map(tuple, ix.postings.filter("id = 'd1'").collect())) == [("d1", "a", 2, 3), ("d1", "b", 1, 3)]
    terms = lexical.query_terms(q, "offline").withColumn("weight", F.lit(1))
    assert terms.count() == 3
    assert lexical.corpus_stats(small, "chunk_id", "text").first()["n"] == 4
    assert lexical.search(ix, q, k=1).count() == 1
    assert lexical.search(ix, q.filter("query_id > 1")).count() == 0


def test_bm25_by_sent_terms_and_by_a_join_agree(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefghij") + rnd.choice("kl") for _ in range(rnd.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "chunk_id string, text string").repartition(4)
    q = spark.createDataFrame([(k, texts[k] + " zz") for k in range(0, 300, 20)], "query_id int, question string")
    ix = lexical.build_index(df)
    rows = lambda: sorted((r.query_id, r.bm25_rank, r.id, round(r.bm25_score, 9)) for r in lexical.search(ix, q, 7).collect())
    monkeypatch.setattr(lexical, "CELLS", 64)
    sent = rows()
    monkeypatch.setattr(lexical, "SENT_TERMS", 3)
    assert rows() == sent and len(sent) > 90


def test_bm25_index_round_trip(spark, small, tmp_path):
    ix = lexical.build_index(small, profile="online")
    ix.write(str(tmp_path / "ix"))
    back = lexical.Bm25Index.read(spark, str(tmp_path / "ix"), "online")
    assert back.stats.first() == ix.stats.first() and back.terms.count() == ix.terms.count()


def test_vector_search(spark):
    rows = [("한글 공지", [1.0, 0.0, 0.0]), ("장학금 공지", [0.0, 1.0, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("short", [1.0]), ("null", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<float>")
    for f in (dense.search, dense.search_by_expression):
        got = f(v, q, 5).orderBy("dense_rank").collect()
        assert got[0].id == "한글 공지" and got[0].dense_score > 0.99 and {r.dense_score for r in got[1:]} <= {0.0, None}
    assert dense.search(v, q.limit(0), 5).count() == 0


def test_vector_search_is_exact(spark, monkeypatch):
    rnd = random.Random(4)
    vs = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(500)]
    v = spark.createDataFrame([(k, x, k % 3) for k, x in enumerate(vs)], "id int, embedding array<double>, g int").repartition(5)
    q = spark.createDataFrame([(k, vs[k]) for k in range(0, 500, 50)], "query_id int, embedding array<double>")
    monkeypatch.setattr(dense, "BLOCK_BYTES", 3 * 64)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    got, per = {}, {}
    for r in dense.search(v, q, 7).collect():
        got.setdefault(r.query_id, {})[r.dense_rank] = r.id
    for r in dense.search_by_group(v, q, 2, "g").collect():
        per.setdefault((r.query_id, r.g), {})[r.dense_rank] = r.id
    for k in range(0, 500, 50):
        want = sorted(range(500), key=lambda j: (-round(cos(vs[k], vs[j]), 9), j))
        assert [got[k][i] for i in range(1, 8)] == want[:7]
        for g in range(3):
            assert [per[k, g][i] for i in (1, 2)] == [j for j in want if j % 3 == g][:2]


def test_no_query_goes_without_a_result(spark, tmp_path):
    from lodestone import catalog

    n = 100_100  # 1001 queries
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).cast("array<float>").alias("embedding"), F.lit("x").alias("label")).filter("vec_id % 100 = 0 or vec_id < 20").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.dense_topk_expression(spark, str(tmp_path)).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {r.query_id: r.n for r in got} == {k: 10 for k in range(0, n, 100)}


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    v = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(60)], "id int, embedding array<float>")
    q = v.filter("id < 7").withColumnRenamed("id", "query_id")
    rows = lambda: sorted(map(tuple, dense.search_by_expression(v, q, 3).collect()))
    whole = rows()
    monkeypatch.setattr(dense, "FEW", 3)
    assert rows() == whole and len(whole) == 21
    assert dense.search_by_expression(v, q.limit(0), 3).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 3.0, 1), (1, "y", 2.0, 2), (1, "z", 1.0, 3)], "query_id int, id string, bm25_score double, bm25_rank int")
    b = spark.createDataFrame([(1, "y", 0.9, 1), (1, "x", 0.8, 2), (1, "z", 0.7, 3), (1, "w", 0.6, 4), (2, "w", 0.6, 1)], "query_id int, id string, dense_score double, dense_rank int")
    got = fusion.rrf(a, b, profile="online").orderBy("query_id", "hybrid_rank").collect()
    assert [(r.query_id, r.id, r.hybrid_score) for r in got] == [(1, "x", 0.032522), (1, "y", 0.032522), (1, "z", 0.031746), (1, "w", 0.015625), (2, "w", 0.016393)]
    with pytest.raises(ValueError, match="no such fusion"):
        fusion.rrf(a, b, method="sum")


CONTENT = "수시 1차 원서접수 기간은 9월입니다. 면접 준비물 안내. 기숙사비 안내. 신입생 장학금 신청. 자율전공학 소개. 총장 연락처"


@pytest.mark.parametrize(("question", "score", "status"), [
    ("수시 1차 원서접수 기간 알려줘", 0.62, "MATCHED"), ("면접 준비물", 0.62, "MATCHED"), ("오늘 날씨 알려줘", 0.71, "OUT_OF_DOMAIN_CUE"), ("내 학번 알려줘", 0.71, "OUT_OF_DOMAIN_CUE"),
    ("수시 1차 원서접수 기간 알려줘", 0.05, "LOW_DENSE_SCORE"), ("수시 1차 일정", None, "NO_RETRIEVAL"), ("?", 0.62, "EMPTY_QUERY_TOKENS"), ("도서관 열람실 좌석 예약", 0.62, "LOW_LEXICAL_RELEVANCE")])
def test_guard(spark, question, score, status):
    q = spark.createDataFrame([(1, question)], "query_id int, question string")
    rows = [] if score is None else [(1, 1, "공지", "테스트", CONTENT, score), (1, 2, "다른", None, "아무 내용", score - 0.01)]
    r = spark.createDataFrame(rows, "query_id int, id int, title string, section string, content string, dense_score double")
    d, e = evidence.refusal_online(q, r)
    got = d.first()
    assert got.status == status and got.allowed == (status == "MATCHED")
    assert [x.id for x in e.collect()] == ([1] if got.allowed else [])
    more = evidence.refusal_online(q, r, Settings.of(refusal_cues=(" 면접 ",)))[0].first()
    assert more.status == (status if "면접" not in question else "MATCHED" if got.coverage == 1 else "OUT_OF_DOMAIN_CUE")


def test_offline_refusals(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "a b c d"), (3, "x"), (4, "a")], "query_id int, question string")
    r = spark.createDataFrame([(1, 1, "a b", 0.1), (2, 1, "a", 0.1), (3, 1, "y", 0.9), (3, 4, "x", 0.9)], "query_id int, rank int, text string, dense_score double")
    got = {x.query_id: x.refusal_reason for x in evidence.refusal_offline(q, r).collect()}
    assert got == {1: "", 2: "LOW_EVIDENCE_COVERAGE", 3: "LOW_TOKEN_OVERLAP", 4: "NO_RETRIEVAL_RESULT"}


def test_answers(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "none"), (3, "gamma")], "query_id int, question string")
    rows = [(1, 1, "Zero. The alpha is one. The alpha beta is two. alpha beta three."), (1, 2, "The alpha beta is two."), (1, 3, "alpha " * 200), (2, 1, "Only this."), (3, 1, "gamma")]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, text string")
    no = q.select("query_id", (c("query_id") == 3).alias("refusal"))
    got = {r.query_id: r.answer for r in answers.compose(q, ranked, no, 60).collect()}
    assert got == {1: ("The alpha beta is two.\n\n" + "alpha " * 200)[:60], 2: "Only this.", 3: "제공된 공지에서 확인되지 않습니다."}
    demo = answers.compose_demo(q, ranked.withColumnRenamed("text", "content").withColumn("similarity", 1.0 - c("rank") * 0.1))
    got = {r.query_id: r.answer for r in demo.collect()}
    assert got[1].startswith("The alpha beta is two. alpha beta three. ") and got[2] == "Only this." and got[3] == "gamma입니다."
    assert {r.query_id: r.answer for r in answers.compose_demo(q, ranked.withColumnRenamed("text", "content").withColumn("similarity", F.lit(1.0)).limit(0)).collect()}[1] == answers.NOTHING_FOUND


def test_context_budget(spark):
    r = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 60), (1, 3, "c"), (2, 1, "d" * 999)], "query_id int, rank int, content string")
    got = {(x.query_id, x["rank"]) for x in answers.context_budget(r, 100).collect()}
    assert got == {(1, 1), (2, 1)}


def test_chat(spark):
    q = spark.createDataFrame([(1, "면접 준비물"), (2, "오늘 날씨"), (3, "면접 준비물")], "query_id int, question string")
    cols = "query_id int, id int, title string, section string, page int, url string, posted_at timestamp, content string, dense_score double"
    r = spark.createDataFrame([(k, 1, "공지", "면접", 2, "http://x", None, CONTENT, 0.6) for k in (1, 2)], cols)
    got = {x.query_id: x for x in answers.chat(q, r).collect()}
    assert got[1].status == "MATCHED" and got[1].answer.endswith("근거:\n- 제목: 공지\n  게시일: 게시일 미상\n  URL: http://x") and got[1].sources[0].label == "공지 / 2p / 면접"
    assert (got[2].status, got[3].status) == ("OUT_OF_DOMAIN_CUE", "NO_RETRIEVAL")
    own = answers.chat(q, r, generate=lambda rows: rows.select("query_id", F.concat(F.lit("re: "), "question").alias("answer"))).filter("query_id = 1").first()
    assert own.answer.startswith("re: 면접 준비물\n\n근거:")


def test_metrics(spark):
    rows = [("m", "a", "n1", ["n1", "n2", "n3"], False, 1.0), ("m", "b", "n2", ["n9", "n2"], False, 2.0), ("m", "", "n1", ["n5", "n6", "n7", "n8", "n9", "n1"], False, None), ("m", "b", "n4", [], True, 3.0), ("m", "b", "", [], True, 0.0), ("m", None, "", None, False, 0.0)]
    got = {r.subset: r for r in metrics.ir_metrics(spark.createDataFrame(rows, "method string, category string, gold_notice_id string, retrieved_notice_ids array<string>, refusal boolean, latency_ms double")).collect()}
    assert set(got) == {"all", "a", "b"}
    a = got["all"]
    assert (a.recall_at_1, a.recall_at_3, a.recall_at_5, a.mrr, a.ndcg_at_5, a.refusal_accuracy, a.avg_latency_ms) == (0.25, 0.5, 0.5, 0.416667, 0.407732, 0.5, 1.0)
    assert got["a"].refusal_accuracy is None and got["b"].refusal_accuracy == 1.0
    assert metrics.metric_table(spark.createDataFrame([("m", "all", 1.0)], "method string, subset string, mrr double")).columns == metrics.COLUMNS


def test_provenance(spark):
    s = Settings()
    assert provenance.retrieval_config_hash(s) == hashlib.sha256("".join(p + "\0" for p in ["retrievalTopK=4", "hybridTopK=5", "bm25TopK=50", "denseTopK=50", "rrfK=60", "fusionMethod=rrf", "minSimilarity=0.18", "responseSourceLimit=3", "refusalMinDenseScore=0.22", "refusalMinTokenOverlap=1", "refusalMinTokenCoverage=0.3", "refusalEvidenceTopK=40", "refusalOutOfDomainCues="]).encode()).hexdigest()
    assert provenance.retrieval_config_hash(s, "offline") != provenance.retrieval_config_hash(s)
    sec = spark.createDataFrame([(2, "B", "p", "md", 0, "s", None, "x"), (1, "A", "p", "md", 1, "t", 3, "z"), (1, "A", "p", "md", 0, "s", None, "y")], "document_id int, title string, path string, content_type string, section_index int, section string, page int, text string")
    want = ["A", "p", "md", "s", "null", "y", "t", "3", "z", "B", "p", "md", "s", "null", "x"]
    assert provenance.corpus_hash(sec).first()[0] == hashlib.sha256("".join(p + "\0" for p in want).encode()).hexdigest()
    d = provenance.corpus_digest(sec).first()[0]
    assert d == provenance.corpus_digest(sec.repartition(3)).first()[0] != provenance.corpus_digest(sec.limit(2)).first()[0]


def test_reindex(spark, tmp_path):
    docs = spark.createDataFrame([("a", "A", "/a.md", "", None, "text", {}, "# H\nalpha beta"), ("b", "B", "/b.md", "", None, "text", {"notice_id": "n"}, "gamma")], "document_id string, title string, path string, url string, posted_at string, content_type string, metadata map<string,string>, text string")
    at = str(tmp_path / "index")
    assert search.reindex(docs, at)[0] == "METADATA_MISSING"
    reason, ix = search.reindex(docs, at)
    assert reason == "INDEX_UP_TO_DATE" and ix.chunks.count() == 2
    assert search.reindex(docs, at, force=True)[0] == "FORCE_REINDEX"
    assert search.reindex(docs.withColumn("text", F.concat("text", F.lit("!"))), at)[0] == "CORPUS_HASH_CHANGED"
    assert search.reindex(docs.limit(1), at)[0] == "DOCUMENT_COUNT_CHANGED"
    q = spark.createDataFrame([(1, "alpha", "", False, "a"), (2, "", "", True, "")], "query_id int, question string, category string, important boolean, gold_notice_id string")
    index = search.documents_index(docs)
    got = {r.question_id: r for r in search.run(index, q, "text_only").collect()}
    assert got[1].top1_notice_id == "a" and got[1].retrieved_notice_ids == ["a", "n"] and got[1].answer == "alpha beta\n\ngamma"
    assert got[2].refusal and got[2].refusal_reason == "LOW_TOKEN_OVERLAP"
    assert search.chat(index, q).count() == 2
    log = search.retrieval_log(search.hybrid(index, q), q, index)
    assert "hybrid_rank" in log.columns and log.count() == 4
