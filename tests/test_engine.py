"""The engine's calls, stored tables, generators and batch jobs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as jobs
from lodestone.defaults import Settings
from lodestone.engine import Engine, Refused
from lodestone.operators import store
from lodestone.operators.generation import Provider, generate

DOCS = [("a", "면접 안내", "/a.md", "http://x/a", None, "text", {"notice_id": "n1"}, "# 면접\n면접 준비물 안내. 신분증과 수험표."), ("b", "장학금", "/b.md", "", None, "text", {}, "신입생 장학금 신청 기간은 3월입니다.")]
SCHEMA = "document_id string, title string, path string, url string, posted_at string, content_type string, metadata map<string,string>, text string"


def test_calls(spark, tmp_path):
    docs, now = spark.createDataFrame(DOCS, SCHEMA), [0.0]
    e = Engine(spark, str(tmp_path / "ix"), Settings.of(retrieval_top_k=4, ip_minute_limit=2), admin_key="k", clock=lambda: now[0])
    with pytest.raises(Refused, match="key"):
        e.reindex(docs, "wrong")
    assert e.reindex(docs, "k") == "METADATA_MISSING"
    with pytest.raises(Refused, match="wait"):
        e.reindex(docs, "k")
    now[0] = 301
    assert e.reindex(docs, "k") == "INDEX_UP_TO_DATE"
    st = e.status().first()
    assert st.counts["chunks"] == 2 and st.index_name == "default"
    q = spark.createDataFrame([(1, "면접 준비물")], "query_id int, question string")
    assert [r.document_id for r in e.bm25_search(q, 99).collect()] == ["a"]
    assert e.dense_search(q, 1).first().document_id == "a"
    assert e.hybrid_search(q, top_k=0, log=str(tmp_path / "log")).count() == 1
    assert spark.read.parquet(str(tmp_path / "log")).first().notice_id == "n1"
    t = datetime(2026, 1, 1)
    r = spark.createDataFrame([(1, "면접 준비물", t, "i", "s"), (2, "오늘 날씨 어때", t, "i", "s"), (3, "면접", t, "i", "s"), (4, " ", t, "j", "s")], "query_id int, question string, ts timestamp, ip string, session_id string")
    got = {x.query_id: x for x in e.chat(r, log=str(tmp_path / "chat")).collect()}
    assert [got[k].status for k in (1, 3, 4)] == ["MATCHED", "RATE_LIMITED", "INVALID"] and "면접 준비물 안내." in got[1].answer and got[2].status in ("OUT_OF_DOMAIN_CUE", "LOW_DENSE_SCORE")
    assert spark.read.parquet(str(tmp_path / "chat")).count() == 2


def test_generators(spark):
    chunk = "array<struct<rank:int,id:int,title:string,posted_at:string,url:string,page:int,section:string,content:string,similarity:double>>"
    rows = spark.createDataFrame([(k, f"q{k}", "p", k == 2, [(1, 1, "t", None, "", None, "", "Alpha q one.", 0.5)]) for k in (1, 2, 3)], f"query_id int, question string, prompt string, important boolean, chunks {chunk}")

    def call(question, prompt, model):
        if question == "q3":
            raise TimeoutError("slow")
        return {"answer": f"{model}:{question}", "input_tokens": 1_000_000, "output_tokens": 0}

    got = {r.query_id: r for r in generate(rows, Provider("p", "small", call, "large")).collect()}
    assert (got[1].answer, got[1].estimated_cost_usd, got[2].answer, got[2].estimated_cost_usd) == ("small:q1", 0.25, "large:q2", 1.25)
    assert (got[3].answer, got[3].provider, got[3].fallback_reason, got[3].estimated_cost_usd) == ("Alpha q one.", "mock", "TimeoutError: slow", None)
    assert {r.provider for r in generate(rows.drop("important"), None).collect()} == {"mock"}
    logs = spark.createDataFrame([("p", "m", 1, 2, 3, 0.5), ("p", "m", None, None, None, None)], "provider string, model string, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd double")
    assert tuple(store.usage_totals(logs).first()) == ("p", "m", 2, 1, 2, 3, 0.5)


def test_stored_tables(spark):
    ns = ("i", "v")
    d = spark.createDataFrame([(1, *ns, "T", "n", "u", None), (2, "i", "old", "O", "n", "u", None)], "id int, index_name string, index_version string, title string, notice_id string, url string, posted_at timestamp")
    k = spark.createDataFrame([(10, 1, *ns, "text"), (11, 2, "i", "old", "text")], "id int, document_id int, index_name string, index_version string, content string")
    v = spark.createDataFrame([(10, *ns, "m", 2, [1.0, 0.0]), (10, *ns, "other", 2, [0.0, 1.0])], "chunk_id int, index_name string, index_version string, embedding_model string, embedding_dim int, embedding array<float>")
    assert [(r.id, r.title) for r in store.documented_chunks(k, d, *ns).collect()] == [(10, "T")]
    assert store.documented_chunks(k, d, " ", None).count() == 2
    assert [r.embedding for r in store.embedded_chunks(k, d, v, *ns, model="m", dim=2).collect()] == [[1.0, 0.0]]
    assert store.has_knowledge_base(d, k, v, *ns) and not store.has_knowledge_base(d, k, v, "i", "old")


def test_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "session", lambda: spark)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("---\nnotice_id: n1\n---\n# H\nalpha beta gamma")
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "alpha beta", "gold_notice_id": "n1"}) + "\n" + json.dumps({"question": "zzz"}))
    (tmp_path / "m.yaml").write_text(f"condition: text_only\ndataset_path: {tmp_path / 'docs'}\n")
    (tmp_path / "run").mkdir()
    jobs.main(["compare", "--questions", str(tmp_path / "q.jsonl"), "--configs", str(tmp_path / "m.yaml"), "--out", str(tmp_path / "run")])
    assert (tmp_path / "run" / "results.csv").read_text("utf-8-sig").startswith("question_id,question,category")
    jobs.main(["evaluate", "--results", str(tmp_path / "run" / "results"), "--out", str(tmp_path / "metrics.csv")])
    line = (tmp_path / "metrics.csv").read_text("utf-8-sig").splitlines()[1].split(",")
    assert line[:6] == ["text_only", "all", "1.0", "1.0", "1.0", "1.0"] and line[18] == "1.0"
    jobs.main(["collect", "--pages", "/root/testdata/sf0.001/pages.parquet", "--out", str(tmp_path / "notices")])
    assert spark.read.json(str(tmp_path / "notices")).count() == 50
    jobs.main(["reindex", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "ix")])
    assert spark.read.parquet(str(tmp_path / "ix" / "index_metadata")).count() == 1
    (tmp_path / "o.jsonl").write_text(json.dumps({"notice_id": "n", "plain_text": "p", "metadata": {}, "blocks": [{"text": "b", "bbox": [0, 0, 1, 1], "confidence": 1.0, "page": 1, "block_type": "body"}]}))
    (tmp_path / "man.jsonl").write_text(json.dumps({"notice_id": "n", "title": "T"}))
    for job in ("build-plain", "build-layout"):
        jobs.main([job, "--results", str(tmp_path / "o.jsonl"), "--manifest", str(tmp_path / "man.jsonl"), "--out", str(tmp_path / job)])
        assert spark.read.parquet(str(tmp_path / job)).filter(F.col("document").contains("# T")).count() == 1
        assert spark.read.json(str(tmp_path / f"{job}_manifest")).select("notice_id", "title").first() == ("n", "T")
        assert json.loads((tmp_path / f"{job}_metadata.json").read_text())["document_count"] == 1
    jobs.main(["collect", "--pages", "/root/testdata/sf0.001/pages.parquet", "--out", str(tmp_path / "few"), "--limit", "7"])
    assert spark.read.json(str(tmp_path / "few")).count() == 7


def test_providers_by_name():
    from lodestone.operators.generation import Provider, answer_mode, routed

    known = {"gemini": Provider("gemini", "m", dict), "openai": Provider("openai", "m", dict, configured=False)}
    assert routed(None, known) is known["gemini"] and routed(" GEMINI ", known) is known["gemini"]
    assert routed("mock", known) is None and routed("openai", known) is None
    assert [answer_mode(n, known) for n in (None, "mock", "openai")] == ["gemini", "mock", "mock-fallback"]
    assert answer_mode("openai", known, allow_mock=False) == "openai-unconfigured"
    with pytest.raises(ValueError, match="unsupported"):
        routed("zzz", known)
    with pytest.raises(ValueError, match="configured"):
        routed("openai", known, allow_mock=False)
