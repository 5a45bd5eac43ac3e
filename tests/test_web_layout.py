"""Pages, recognised blocks, admission, streams, files, and every query against its SQL."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.defaults import Settings
from lodestone.operators import admission, layout, web
from lodestone.sources import readers, sinks
from lodestone.streaming import events

c = F.col


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("r")).first()["r"]


PAGE = """<html><head><title>T &amp; <b>x</b></title><style>p{}</style></head><body><div id="top">menu</div>
<div class="a board-view-cont b"><p>Hello<br>world</p><div>inner &lt;3</div><img src="/files/p.png" alt="poster"><script>var x='<p>no</p>'</script>
<li>same</li><li>same</li><a href="down?file=/f/plan.PDF">f</a> <a href="/site/resource/i.png">r</a> <a href="javascript:x()">j</a> <a href="#a">h</a> <a href="http://o.org/d.hwp?x=1">o</a></div>
<div id='IContents_div첨부파일'><a href='/files/p.png'>again</a><a href="e.zip">z</a></div><span id="IContents_span작성일시">2026.3.7 9:05</span></body></html>"""


def test_pages(spark):
    assert one(spark, web.visible_text(web.content_region(c("t"))), PAGE) == "Hello\nworld\ninner <3\nposter\nsame\nf r j h o"
    assert web.page_lines(PAGE, alt=False)[1:3] == ["menu", "Hello"]
    assert one(spark, web.visible_text(c("t")), None) == ""
    assert one(spark, web.page_title(c("t")), PAGE) == "T & x"
    assert one(spark, web.page_title(c("t")), "<a x id='IContents_atitle' y> A <i>b</i> </a><title>no</title>") == "A b"
    assert one(spark, web.page_title(c("t")), "<p>") == "제목 없음"
    assert one(spark, web.posted_at(c("t")), PAGE) == "2026-03-07T09:05:00+09:00"
    assert one(spark, web.posted_at(c("t")), "<p>2025-12-1 and</p>") == "2025-12-01T00:00:00+09:00"
    assert one(spark, web.posted_at(c("t")), "none") is None
    assert web.attachments_in(web.Page(PAGE), "http://h.org/a/b") == ["http://h.org/f/plan.PDF", "http://o.org/d.hwp?x=1", "http://h.org/files/p.png", "http://h.org/a/e.zip"]
    assert one(spark, web.content_text(c("t")), PAGE) == one(spark, web.visible_text(web.content_region(c("t"))), PAGE)
    assert web.Page("<div id='x'><div></div>").div("id='x'") is None
    nested = "<div id='x'>a<div>b</div></div>c"
    assert web.Page(nested).div("id='x'") == (0, len(nested) - 1)


def test_markup_that_is_not_well_formed():
    lines = web.page_lines
    assert lines("a<!-- <p>no</p> -->b<!doctype x>c") == ["abc"]
    assert lines("a<script>if (1<2) x='</p>'</script>b<style>p{}") == ["ab"]
    assert lines("<noscript>a<noscript>b</noscript>c</noscript>d") == ["d"]
    assert lines("<a title='x>y'>t</a> 1 < 2 <3 &amp;lt;") == ["t 1 < 2 <3 <"]
    assert lines("a<p") == ["a<p"] and lines("") == lines(None) == []
    assert web.notice_links("<a href='/b/boardview/1/2?x=1#y'>", "http://h") == ["http://h/b/boardview/1/2?x=1"]
    long = "<a '" * 100_000 + "<div>" * 100_000
    assert web.Page(long).div("x") is None


def test_urls(spark):
    u = "https://h.org/main/boardview/19/77?x#y"
    assert one(spark, web.notice_id(c("t")), u) == "main_19_77"
    assert one(spark, web.notice_id(c("t")), "http://a").startswith("notice_") and len(one(spark, web.notice_id(c("t")), "http://a")) == 19
    cat = web.category_of(c("t"), {"19": "입학 공지사항"}, {"/www/": "site"})
    assert [one(spark, cat, x) for x in (u, "http://h/x/board/20", "http://h/www/boardview/3/4", "http://h/")] == ["입학 공지사항", "게시판 20", "site", "공지"]
    assert one(spark, web.department_of(c("t"), [("adm", "/adm/", "A"), ("h.org", "", "H")]), u) == "H"
    html = '<a href="/m/boardview/1/2#c">a</a><a href="http://o/m/boardview/1/3">b</a><a href="/m/boardview/1/2">c</a>'
    assert web.notice_links(html, "http://h/s") == ["http://h/m/boardview/1/2"]
    seeds = spark.createDataFrame([("http://h/s", html), ("http://h/t", html)], "url string, html string")
    assert [r.url for r in web.discover(seeds, other_hosts=True).orderBy("position").collect()] == ["http://h/m/boardview/1/2", "http://o/m/boardview/1/3"]


def test_notices(spark):
    pages = spark.createDataFrame([(1, "http://h/m/boardview/19/1", PAGE), (2, "http://h/m/boardview/19/2", PAGE.replace("menu", "other")), (3, "http://h/3", "<p>" + "long text " * 20)], "seq int, url string, html string")
    got = {r.seq: r for r in web.collect_notices(pages).collect()}
    assert (got[1].is_duplicate, got[2].is_duplicate, got[2].duplicate_of, got[3].content_type) == (False, True, "m_19_1", "text")
    assert got[1].content_type == "mixed"
    counts = {r.content_type: r.n for r in web.content_type_counts(web.collect_notices(pages)).collect()}
    assert counts == {"text": 1, "image": 0, "pdf": 0, "mixed": 1}


def test_site_structure(spark):
    html = '<h5 class="card-title">Cat</h5><ul class="list-group list-group-flush"><li><a href=" /a " x>Dep <b>1</b></a></li><li><a href="/b">Dep 2</a></li></ul>'
    assert [tuple(r) for r in one(spark, web.department_cards(c("t")), html)] == [("Cat", "Dep 1", "/a"), ("Cat", "Dep 2", "/b")]
    menu = '<a href="/x" role="menuitem">교육 목표</a><a href="#" role="menuitem">no</a><a href="/y" role="menuitem">취업광장 진로</a><a href="/z" role="menuitem">진로</a>'
    assert web.menu_items_of(menu, "http://h/") == [("교육 목표", "http://h/x"), ("취업광장 진로", "http://h/y"), ("진로", "http://h/z")]
    items = spark.createDataFrame([(menu, "http://h/")], "h string, u string").select(web.menu_items(c("h"), c("u")).alias("i"), "u")
    got = items.select(web.choose_sections(c("i"), [("목표", ["목표"]), ("진로", ["진로"]), ("없음", ["없음"])], c("u"), not_for={"진로": ["취업광장"]}).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == [("교육 목표", "http://h/x"), ("진로", "http://h/z")]
    lines = ["Dep", "menu", "a", "a", "2026.01.02", "COPYRIGHT x", "b", "Q&A", "stop", "c"]
    own = web.section_lines(c("t"), F.lit("Dep"), F.array(F.lit("menu")), F.lit("Title"), stop=["stop"], limit=5)
    assert one(spark, own, lines, "array<string>") == ["a", "b"]
    meta = spark.createDataFrame([(1, "- A: 2년제, 입학정원 40"), (2, "- A: 3년제"), (3, "- B: 야간"), (4, "x")], "line_no int, line string")
    assert sorted(map(tuple, web.program_meta(meta).collect())) == [("A", "2년제", "40"), ("B", None, None)]
    named = spark.createDataFrame([("A", 1), ("Z", 2)], "name string, k int")
    assert sorted(map(tuple, web.with_programs(named, meta).collect())) == [("A", 1, "2년제", "40"), ("Z", 2, None, None)]
    rec = spark.createDataFrame([(1, "C2", "n1", "u", "2년제", "40", [("L", ["x"])], ["o", "o", "p"]), (2, "C1", "n2", "v", "", None, [], [])], "seq int, category string, name string, url string, duration string, capacity string, sections array<struct<label:string,bullets:array<string>>>, office array<string>")
    md = web.department_markdown(rec, ["C1", "C2", "C3"], ["# H", ""]).first()["markdown"]
    assert md == "# H\n\n## C1\n\n### n2\n- 공식 학과 페이지: v\n\n## C2\n\n### n1\n- 공식 학과 페이지: u\n- 학제 및 입학정원 참고: 2년제, 입학정원 40\n- L\n  - x\n- 학과사무실 참고\n  - o\n  - p\n"
    over = web.school_overview(spark.createDataFrame([(1, "정시"), (2, "수시"), (3, "정시")], "pos int, line string"), rec.select("seq", "category", "name"), ["C1", "C2"], ["정시", "수시"], ["none"], ["# T"])
    assert over.first()["markdown"] == "# T\n\n## 주요 메뉴\n- 정시\n- 수시\n\n## 안내 메뉴\n\n## 학과 및 전공 계열 구성\n### C1\n- n2\n### C2\n- n1\n"
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a")], "p int, o int, v string")
    assert [r.o for r in web.consecutive_unique(rows, "p", "o", "v").orderBy("o").collect()] == [1, 3, 4]


@pytest.mark.parametrize(("t", "dates", "contacts"), [("2026학년도 입학식 안내", [], []), ("마감일: 2026년 2월 27일", ["2026년 2월 2"], []), ("x 2026.01.10", ["2026.01.1"], []), ("문의: 031-363-7700 / admissions@example.ac.kr", ["1-3", "3-7"], ["031-363-7700", "admissions@example.ac.kr"])])
def test_dates_and_contacts(spark, t, dates, contacts):
    assert (one(spark, layout.dates(c("t")), t), one(spark, layout.contacts(c("t")), t)) == (dates, contacts)


def test_blocks(spark):
    kind = lambda t, raw, conf: one(spark, layout.block_type(c("t"), F.lit(raw), F.lit(conf)), t)
    assert [kind("a", " Title ", 0.0), kind("tel 031-363-7700", "body", 1.0), kind("2026.1.2", "x", 1.0), kind("a|b\nc|d", "x", 1.0), kind("2026.1.2" + "x" * 80, "x", 1.0), kind("a", "unknown", 0.0), kind("a", "unknown", 0.5)] == ["title", "contact", "date", "table", "body", "unknown", "body"]
    assert one(spark, layout.table_markdown(c("t")), "|a|b|\nc|d|e\n\nf") == "| a | b |  |\n| --- | --- | --- |\n| c | d | e |\n| f |  |  |"
    assert one(spark, layout.table_markdown(c("t")), "k: v: w") == "| 항목 | 값 |\n| --- | --- |\n| k | v: w |"
    assert one(spark, layout.table_markdown(c("t")), "plain") == "plain"
    assert one(spark, layout.polygon_bbox(c("t")), [[3.0, 1.0], [5.0, 4.0], [2.0, 2.0]], "array<array<double>>") == [2.0, 1.0, 5.0, 4.0]
    assert one(spark, layout.polygon_bbox(c("t")), [], "array<array<double>>") == one(spark, layout.normalize_bbox(c("t")), [1.0], "array<double>") == [0.0] * 4
    assert one(spark, layout.dates(c("t"), whole_days=True), "2026.01.10") == ["2026.01.10"]


RESULTS = [{"notice_id": "n/1", "file_path": "a.png", "ocr_engine": "e", "engine_version": "1", "preprocess_profile": "none", "plain_text": "p  q", "metadata": {}, "blocks": [
    {"text": "second", "bbox": [0, 20, 5, 25], "confidence": 0.9, "page": 1, "block_type": "body"}, {"text": " ", "bbox": [0, 10, 5, 15], "confidence": 0.9, "page": 1, "block_type": "body"},
    {"text": "Head", "bbox": [9, 0, 5, 5], "confidence": 0.2, "page": 1, "block_type": "title"}, {"text": "none", "bbox": None, "confidence": None, "page": 0, "block_type": None}]},
    {"notice_id": "n2", "file_path": "b.png", "plain_text": " ", "metadata": {"title": "Own"}, "blocks": [{"text": "x", "bbox": [0, 0, 1, 1], "confidence": 0.5, "page": 2, "block_type": "table"}]}]
MANIFEST = [{"notice_id": "n/1", "title": "Old", "url": "u0"}, {"notice_id": ""}, {"notice_id": "n/1", "title": "New", "url": "u1", "posted_at": "2026"}]


def test_layout_corpus(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "ocr.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RESULTS) + "\n\n")
    (tmp_path / "r" / "more.example.jsonl").write_text(json.dumps(RESULTS[0]))
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps(r) for r in MANIFEST))
    results, manifest = readers.ocr_results(spark, str(tmp_path / "r")), readers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert results.count() == 2 and readers.ocr_results(spark, str(tmp_path / "r"), examples=True).count() == 3
    assert [r.title for r in manifest.collect()] == ["New"]
    got = {r.chunk_id: r for r in layout.layout_chunks(results, manifest).collect()}
    assert list(sorted(got)) == ["layout_n2_2_0001", "layout_n_1_1_0001", "layout_n_1_1_0002", "layout_n_1_1_0004"]
    head, none = got["layout_n_1_1_0002"], got["layout_n_1_1_0001"]
    assert (head.title, head.url, head.markdown_text) == ("New", "u1", "# Head") and (none.block_type, none.confidence) == ("unknown", 0.0)
    assert got["layout_n2_2_0001"].title == "Own" and got["layout_n2_2_0001"].url is None
    doc = layout.chunk_document(layout.layout_chunks(results, manifest)).filter("chunk_id = 'layout_n_1_1_0004'").first().document
    assert doc.startswith("---\nnotice_id: n/1\nsource_image_path: a.png\n") and doc.endswith("- confidence: 0.9000\n- bbox: [0.0, 20.0, 5.0, 25.0]\n\nsecond\n")
    plain = layout.plain_documents(results, manifest)
    assert [(r.notice_id, r.text, r.title) for r in plain.collect()] == [("n/1", "p q", "New")]
    assert layout.plain_document(plain).first().document.endswith("---\n\n# New\n\np q\n")
    both = layout.corpus(spark.createDataFrame([("t", "x")], "notice_id string, text string"), plain)
    assert both.count() == 2
    d = spark.createDataFrame([("t", "text", 2), ("l", "image_ocr_layout_chunk", 1)], "document_id string, content_type string, chunk_count int")
    m = layout.index_metadata(d, layout.layout_chunks(results, manifest)).first()
    assert (m.document_count, m.text_document_count, m.chunk_count, m.layout_chunk_count, m.low_confidence_chunk_count) == (2, 1, 3, 4, 2)
    assert {r.block_type: r.n for r in layout.block_type_counts(layout.layout_chunks(results, manifest)).collect()}["date"] == 0
    e = layout.engine_summary(results.withColumn("elapsed_seconds", F.lit(2.0)).withColumn("ocr_engine", F.lit("e")).withColumn("preprocess_profile", F.lit("none"))).first()
    assert (e.succeeded, e.failed, e.avg_elapsed_seconds) == (2, 0, 2.0)


def test_engines_may_fail(spark):
    files = spark.createDataFrame([("a", "x.png"), ("b", "bad.png")], "notice_id string, file_path string")

    def engine(path, notice, profile):
        if path == "bad.png":
            raise RuntimeError("cannot read")
        return {"plain_text": f"{notice}:{profile}", "blocks": [{"text": "t", "bbox": [0.0, 0.0, 1.0, 1.0], "confidence": 1.0, "page": 1, "block_type": "body"}]}

    got = {(r.notice_id, r.preprocess_profile): r for r in readers.recognise(files, engine, ["none", "basic"]).collect()}
    assert len(got) == 4 and got["a", "basic"].plain_text == "a:basic" and got["b", "none"].error == "RuntimeError: cannot read"


def requests(spark, rows):
    return spark.createDataFrame([(k, datetime(2026, 4, 14) + timedelta(seconds=s), ip, sid) for k, (s, ip, sid) in enumerate(rows)], "request_id int, ts timestamp, ip string, session_id string")


def decided(spark, rows, **limits):
    off = dict.fromkeys(("ip_minute_limit", "ip_daily_limit", "session_minute_limit", "session_daily_limit"), 0)
    return [r.admitted for r in admission.decide(requests(spark, rows), Settings.of(**off | limits)).orderBy("request_id").collect()]


def test_admission(spark):
    assert decided(spark, [(0, "a", None)] * 3, ip_minute_limit=2) == [True, True, False]
    assert decided(spark, [(0, None, "s"), (1, None, "s"), (61, None, "s")], session_minute_limit=1) == [True, False, True]
    assert decided(spark, [(0, None, "s"), (60, None, "s")], session_minute_limit=1) == [True, False]
    assert decided(spark, [(0, "a", None), (70, "a", None), (86400, " a ", None)], ip_daily_limit=1) == [True, False, True]
    assert decided(spark, [(86399, "a", None), (86400, "a", None)], ip_minute_limit=1) == [True, True]  # a new day clears the window
    # The session turns the second away, and the address's place is used all the same.
    assert decided(spark, [(0, "a", "s"), (1, "a", "s"), (2, "a", "t")], ip_minute_limit=2, session_minute_limit=1) == [True, False, False]
    assert decided(spark, [(0, "", " ")] * 3, ip_minute_limit=1, session_minute_limit=1) == [True] * 3


def plain_decisions(rows, s):
    counters, out = {}, []
    for sec, ip, sid in rows:
        ok = True
        for key, minute, daily in ((ip and "i" + ip, s.ip_minute_limit, s.ip_daily_limit), (sid and "s" + sid, s.session_minute_limit, s.session_daily_limit)):
            if not key or not ok:
                continue
            day, times, n = counters.get(key, (None, [], 0))
            if day != sec // 86400:
                day, times, n = sec // 86400, [], 0
            times = [t for t in times if t >= sec - s.rate_window_seconds]
            ok = len(times) < minute and n < daily
            counters[key] = (day, times + [sec] * ok, n + ok)
        out.append(ok)
    return out


def test_admission_is_the_plain_rule(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted((rnd.randrange(0, 200_000), f"i{rnd.randrange(3)}", f"s{rnd.randrange(6)}") for _ in range(1500))
    s = Settings.of(ip_minute_limit=4, ip_daily_limit=200, session_minute_limit=2, session_daily_limit=60, rate_window_seconds=600)
    r = requests(spark, rows)
    got = admission.decide(r.repartition(7), s).orderBy("request_id").collect()
    assert [x.admitted for x in got] == plain_decisions(rows, s)
    # A stream decides as a table does.
    for k in range(3):
        r.filter(f"request_id >= {500 * k} and request_id < {500 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.admission_stream(stream, "session_id", "session", s).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    only = Settings.of(ip_minute_limit=0, ip_daily_limit=0, session_minute_limit=2, session_daily_limit=60, rate_window_seconds=600)
    want = {x.request_id: x.admitted for x in admission.decide(r, only).collect()}
    assert {x.request_id: x.admitted for x in spark.table("told").collect()} == want


def test_cooldown(spark):
    r = spark.createDataFrame([(k, datetime(2026, 1, 1) + timedelta(seconds=s), "x") for k, s in enumerate((0, 299, 300, 301, 600))], "request_id int, ts timestamp, index_name string")
    assert [x.accepted for x in admission.cooldown(r).orderBy("request_id").collect()] == [True, False, True, False, True]


def test_streams(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, m), "h" + str(m % 3), "a", m * 1.0) for m in range(0, 59, 7)]
    t = spark.createDataFrame(rows, "ts timestamp, source_hash string, event_type string, value double").withColumn("user_id", F.lit(1))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(datetime(2026, 1, 1, 9), "z", "a", 0.0)], "ts timestamp, source_hash string, event_type string, value double").withColumn("user_id", F.lit(1))

    def run(f, name):
        (tmp_path / name).mkdir()
        src = str(tmp_path / name / "in")
        t.coalesce(1).write.parquet(src)
        late.coalesce(1).write.mode("append").parquet(src)
        s = f(spark.readStream.schema(t.schema).parquet(src))
        q = s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    assert sorted((r.start, r.n) for r in run(events.window_counts, "w")) == sorted((r.start, r.n) for r in events.window_counts(t).collect())
    assert {r.source_hash for r in run(events.first_of_hash, "f")} == {"h0", "h1", "h2", "z"}
    assert events.session_counts(t).first().n == len(rows)
    assert events.first_of_hash(t).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "d" / "s").mkdir(parents=True)
    (tmp_path / "d" / "a_b.md").write_text("---\ntitle: T\nurl: http://x\n---\n# H\nbody")
    (tmp_path / "d" / "s" / "c.TXT").write_text("plain")
    (tmp_path / "d" / "x.bin").write_bytes(b"\0")
    (tmp_path / "d" / "p.pdf").write_bytes(b"one\fthree\f ")
    assert {r.path.rpartition("/")[2] for r in readers.glob_scan(spark, str(tmp_path / "d")).collect()} == {"a_b.md", "c.TXT", "p.pdf"}
    docs = {r.document_id: r for r in readers.markdown_documents(spark, str(tmp_path / "d")).collect()}
    assert docs["a_b"].title == "T" and docs["a_b"].text == "\n# H\nbody" and docs["c"].title == "c" and set(docs) == {"a_b", "c"}
    pages = readers.pdf_sections(readers.glob_scan(spark, str(tmp_path / "d"), ("pdf",)), lambda b: b.decode().split("\f"))
    assert [(r.section, r.page, r.text) for r in pages.collect()] == [("Page 1", 1, "one"), ("Page 2", 2, "three")]
    (tmp_path / "q.jsonl").write_text('\n{"question": "a?"}\n{"question_id": "x", "question": "b?", "important": true}\n')
    q = {r.question_id: r for r in readers.questions(spark, str(tmp_path / "q.jsonl")).collect()}
    assert set(q) == {"q002", "x"} and q["q002"].gold_notice_id == "" and q["q002"].expected_source_keywords == [] and q["x"].important
    (tmp_path / "s.jsonl").write_text('{"notice_id": "n", "file_path": "f"}')
    assert readers.ocr_samples(spark, str(tmp_path / "s.jsonl")).first().expected_features == []


def test_settings_files(tmp_path):
    (tmp_path / "m.yaml").write_text('# c\ncondition: x\nchunk_size: 500\nretrieval:\n  rrf_k: 10\n  list:\n    - a\ngeneration:\n  model: "m"\n  temperature: 0.5\n')
    m = readers.method_config(str(tmp_path / "m.yaml"))
    assert (m["method"], m["chunk_size"], m["rrf_k"], m["generation_model"], m["temperature"], m["final_top_k"]) == ("x", 500, 10, "m", 0.5, 5)
    assert [readers.parse_setting(v) for v in ("True", "1", "1.5", "'a'", "1.2.3")] == [True, 1, 1.5, "a", "1.2.3"]
    url, props = readers.jdbc_url("postgres://demo-user:demo%2Dpass@demo-host:5432/demo_db?sslmode=require")
    assert url == "jdbc:postgresql://demo-host:5432/demo_db?sslmode=require" and props["user"] == "demo-user" and props["password"] == "demo-pass"
    assert readers.jdbc_url("jdbc:h2:mem:x")[0] == "jdbc:h2:mem:x"
    with pytest.raises(ValueError, match="address"):
        readers.jdbc_url(" ")


def test_requests_that_are_no_questions(spark):
    r = spark.createDataFrame([("a", "s"), (" ", "s"), (None, None), ("q" * 501, ""), ("q", "s" * 101)], "question string, session_id string")
    ok, bad = readers.valid_questions(r)
    assert ok.count() == 1 and bad.count() == 4


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("나", 'a "q"\nb', ["x", "y"], None), ("b", "", [], 1.5)], "z string, a string, l array<string>, n double")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    raw = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*")))
    assert '{"a":"a \\"q\\"\\nb","l":["x","y"],"n":null,"z":"나"}' in raw
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("z").collect()
    assert back[1].a == 'a "q"\nb' and back[1].l == '["x","y"]'
    sinks.write_csv_file(df, str(tmp_path / "one.csv"), ["z", "l", "missing"])
    assert (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbfz,l,missing\r\n")
    sinks.write_document(df.limit(1), str(tmp_path / "d.json"))
    assert "나" in (tmp_path / "d.json").read_text()
    with pytest.raises(ValueError, match="one row"):
        sinks.write_document(df, str(tmp_path / "d.json"))
    ix = lambda v, x: spark.createDataFrame([("i", v, x)], "index_name string, index_version string, x int")
    sinks.replace_index(ix("v1", 1).unionByName(ix("v2", 2)), str(tmp_path / "ix"))
    sinks.replace_index(ix("v1", 3), str(tmp_path / "ix"))
    assert sorted((r.index_version, r.x) for r in spark.read.parquet(str(tmp_path / "ix")).collect()) == [("v1", 3), ("v2", 2)]
    sinks.append_log(ix("v1", 1), str(tmp_path / "log"))
    sinks.append_log(ix("v1", 2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert sorted(r.id for r in sinks.with_ids(spark.range(50).withColumnRenamed("id", "k"), ["k"]).collect()) == list(range(1, 51))
    sinks.write_files(spark.createDataFrame([("s/a.md", "text")], "path string, document string"), str(tmp_path / "f"))
    assert (tmp_path / "f" / "s" / "a.md").read_text() == "text"
    sinks.reset_folder(spark, str(tmp_path / "f"), str(tmp_path))
    assert not list((tmp_path / "f").iterdir())
    with pytest.raises(ValueError, match="outside"):
        sinks.reset_folder(spark, "/elsewhere", str(tmp_path))


def test_schemas(spark):
    from lodestone import schemas

    assert len(schemas.TABLES) == 13 and all(schemas.schema(n).fields for n in [*schemas.TABLES, *schemas.FILES])
    v = spark.createDataFrame([([1.0, 2.0],), (None,)], "e array<float>")
    assert schemas.check_dimension(v, "e", 2).count() == 2
    with pytest.raises(Exception, match="vector of 3 numbers"):
        schemas.check_dimension(v, "e", 3).collect()
