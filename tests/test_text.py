"""Text functions, tokenizers, hashes and numbers against values worked out by hand or by plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.defaults import Settings, clamp_limits
from lodestone.functions import numbers, text, tokenizers, vectors

c = F.col


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'array<double>' if v and isinstance(v[0], float) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x int").select(column.alias("r")).first()["r"] if values else spark.range(1).select(column.alias("r")).first()["r"]


def test_normalize_and_strip(spark):
    assert one(spark, text.normalize(c("t")), t=" a\r\n\t b  c\n\n\n\nd \n") == "a\n b c\n\nd"
    assert one(spark, text.strip(c("t")), t="\n x \t") == "x"


@pytest.mark.parametrize(("raw", "meta", "body"), [
    ("---\ntitle: \"A: b\"\nn: 3\nflag: True\ntitle: 'C'\nnone\n---\nbody\n---", {"title": "C", "n": "3", "flag": "true"}, "\nbody\n---"),
    ("---\nno end", {}, "---\nno end"), ("plain", {}, "plain"), ("", {}, "")])
def test_front_matter(spark, raw, meta, body):
    got = one(spark, text.front_matter(c("t")), t=raw)
    assert (got["metadata"], got["body"]) == (meta, body)


def test_titles(spark):
    assert one(spark, text.title_from_filename(c("t")), t="2026_모집_요강.v2.md") == "2026 모집 요강.v2"
    assert one(spark, text.first_heading(c("t")), t="x\n## Head \n# Other") == "Head"
    assert one(spark, text.first_heading(c("t")), t="x") is None
    assert one(spark, text.summarize_title(c("a"), c("b")), a=" T  x ", b="") == "T x"
    assert one(spark, text.summarize_title(c("a"), c("b")), a="T", b="s" * 99) == ("T / " + "s" * 99)[:80]
    assert one(spark, text.infer_content_type(c("t")), t="/a/ocr_layout/b/layout_chunks/c.md") == "image_ocr_layout_chunk"
    assert one(spark, text.document_title(F.create_map().cast("map<string,string>"), c("b"), c("p")), b="no heading", p="/x/a_b.md") == "a b"


def test_labels_footers_prompts(spark):
    assert one(spark, text.source_label(c("t"), F.lit(3), c("s")), t="T", s=" ") == "T / 3p"
    assert one(spark, text.snippet(c("t")), t="a  b\n" * 100) == ("a b " * 100)[:180] + "..."
    src = F.array(text.source_reference(c("t"), F.lit(None).cast("int"), F.lit("S"), F.lit("body"), F.lit(0.12345), F.lit(""), F.lit(None).cast("string")))
    assert one(spark, text.with_sources(F.lit(" yes "), src), t="T") == "yes\n\n근거:\n- 제목: T\n  게시일: 게시일 미상\n  URL: URL 없음"
    assert one(spark, src, t="T")[0]["score"] == 0.123
    chunk = F.array(F.struct(F.lit("T").alias("title"), F.lit(None).cast("string").alias("posted_at"), F.lit("").alias("url"), F.lit(2).alias("page"), F.lit("S").alias("section"), F.lit("body").alias("content")))
    got = one(spark, text.user_prompt(c("q"), chunk), q="why?")
    assert got.startswith("질문:\nwhy?\n\n근거 문서:\nsource_title: T\nposted_at: unknown\nurl: unknown\npage: 2\nsection: S\ncontent:\nbody\n\n답변 규칙:\n- ")


def test_small_text_functions(spark):
    assert one(spark, text.safe_filename(c("t")), t="__a b/가?.md_") == "a_b_가_.md"
    assert one(spark, text.safe_filename(c("t")), t="??") == "unknown"
    assert one(spark, text.ordered_unique(c("t")), t=["b", "", "a", "b"]) == ["b", "a"]
    assert one(spark, text.sentences(c("t")), t="A b. C!  D\n\nE。 F") == ["A b.", "C!", "D", "E。", "F"]
    assert one(spark, text.parse_vector(text.vector_literal(c("t").cast("array<float>"))), t=[1.5, -2.0]) == [1.5, -2.0]
    for raw, want in (('["a", "", "b"]', ["a", "b"]), ("a | b|", ["a", "b"]), (None, [])):
        assert one(spark, text.id_list(c("t")), t=raw) == want


def plain_tokens(t, suffixes, unique):
    out = []
    for w in re.split(r"[\W_]+", t.lower()):
        for s in suffixes:
            if len(w) > len(s) + 1 and w.endswith(s):
                w = w[: -len(s)]
                break
        if len(w) >= 2 and not (unique and w in out):
            out.append(w)
    return out


def test_tokenizers(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("가학교에서으로는 요야 ab1é漢,.-\n") for _ in range(60)) for _ in range(200)] + ["", "자율전공학과 뭐야", "학교에서부터"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tokenizers.unicode_tokens(c("t")).alias("a"), tokenizers.evidence_tokens(c("t")).alias("b"), tokenizers.alnum_tokens(c("t")).alias("d"), tokenizers.whitespace_tokens(c("t")).alias("e"), tokenizers.guard_tokens(c("t")).alias("g")).collect()
    for r in got:
        assert r.a == plain_tokens(r.t, tokenizers.SUFFIXES, False), r.t
        long_ = " ".join(w for w in re.split(r"[\W_]+", r.t.lower()) if len(w) >= 2)
        assert r.b == plain_tokens(long_, tokenizers.MORE_SUFFIXES, True)
        assert r.d == [w.lower() for w in re.findall("[0-9A-Za-z가-힣]+", r.t)]
        assert r.e == [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in r.t.lower().split()) if len(w) >= 2]
        assert set(r.g) == set(r.b) | {w for w in long_.split()}
    assert one(spark, tokenizers.guard_tokens(c("t")), t="자율전공학과 뭐야") == ["자율전공학", "뭐야", "자율전공학과"]
    assert one(spark, tokenizers.unicode_tokens(c("t")), t=None) == []


@pytest.mark.parametrize(("token", "h", "online", "offline", "sign"), [("수시", 1590212, 196, 237, 1), ("원서접수", 1565388147, 115, 84, -1), ("장학금", 50853428, 52, 144, 1)])
def test_hashes(spark, token, h, online, offline, sign):
    assert one(spark, vectors.java_hash(c("t")), t=token) == h
    assert one(spark, vectors.bucket_and_sign(c("t"), "online", 256)[0], t=token) == online
    b, s = vectors.bucket_and_sign(c("t"), "offline", 256)
    assert (one(spark, b, t=token), one(spark, s, t=token)) == (offline, sign)
    assert one(spark, vectors.java_hash(c("t")), t="polygenelubricants") == -2147483648


@pytest.mark.parametrize("profile", ["online", "offline"])
def test_embeddings_agree(spark, profile):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["수시 원서접수 장학금 수시", "a b a", "", "x y z w" * 9])], "id int, text string")
    sparse = {}
    for r in vectors.sparse_embedding(df, "id", "text", profile).collect():
        sparse.setdefault(r.id, {})[r.bucket] = r.weight
    for r in vectors.with_embedding(df, "text", profile).collect():
        assert {k: pytest.approx(v, abs=1e-6) for k, v in enumerate(r.embedding) if v} == sparse.get(r.id, {})
        assert len(r.embedding) == 256


def test_similarities(spark):
    assert one(spark, vectors.cosine(c("a"), c("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(c("a"), c("b")), a=[1.0], b=[1.0, 1.0]) == 0
    assert one(spark, vectors.cosine(c("a"), c("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, vectors.dot(c("a"), c("b")), a=[2.0], b=[3.0, 9.0]) == 6
    assert one(spark, vectors.sha256_parts(c("a")), a=["x", "y"]) == hashlib.sha256(b"x\0y\0").hexdigest() == vectors.sha256_of(["x", "y"])


def test_numbers(spark):
    assert [one(spark, numbers.round_half_up(c("x"), 0), x=v) for v in (2.5, -2.5, -2.51)] == [3, -2, -3]
    usd = numbers.estimate_usd(c("i"), c("o"), c("b"))
    assert one(spark, usd, i=1_000_000, o=500_000, b=False) == 1.25
    assert one(spark, usd, i=1_000_000, o=500_000, b=True) == 6.25
    assert one(spark, numbers.estimate_usd(c("i"), F.lit(None).cast("int"), c("b")), i=1, b=True) is None
    assert one(spark, numbers.effective_model(c("b"), F.lit("m"), c("k")), b=True, k=" ") == "m"
    assert tuple(one(spark, numbers.upscaled(c("w"), c("h"), 1600), w=992, h=1403)) == (1132, 1600)
    plan = one(spark, numbers.preprocess_plan(c("w"), c("h"), F.lit("raw")), w=992, h=1403)
    assert (plan.width, plan.height, plan.operations) == (992, 1403, ["use_original_image"])
    with pytest.raises(Exception, match="unsupported profile"):
        one(spark, numbers.preprocess_plan(c("w"), c("h"), F.lit("odd")), w=1, h=1)
    assert clamp_limits("hybrid", top_k=99, bm25_top_k=0, rrf_k=60) == {"top_k": 50, "bm25_top_k": 1, "rrf_k": 60}
    with pytest.raises(ValueError, match="no such settings"):
        Settings.of(nothing=1)


@pytest.mark.parametrize(("remote", "fwd", "real", "trusted", "want"), [
    ("10.0.0.1", "1.2.3.4, 5.6.7.8", None, ["10.0.0.1"], "1.2.3.4"), ("10.0.0.2", "1.2.3.4", None, ["10.0.0.1"], "10.0.0.2"), ("::ffff:10.0.0.1", None, "9.9.9.9", ["10.0.0.1"], "9.9.9.9"),
    ("8.8.8.8", " ", None, ["*"], "8.8.8.8"), ("0:0:0:0:0:0:0:1", "::ffff:7.7.7.7", None, ["::1"], "7.7.7.7"), ("", "1.1.1.1", None, ["*"], None)])
def test_client_addresses(spark, remote, fwd, real, trusted, want):
    assert one(spark, numbers.client_ip(c("a"), c("b"), c("d"), trusted), a=remote, b=fwd, d=real) == want
    assert one(spark, numbers.client_ip(c("a"), c("b"), c("d"), trusted, trust_headers=False), a=remote, b=fwd, d=real) == one(spark, numbers.normal_address(c("a")), a=remote)
