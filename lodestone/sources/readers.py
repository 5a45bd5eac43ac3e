"""Scans of files and databases, and settings files."""

from __future__ import annotations

import re
from contextlib import suppress
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, document_title, extension, front_matter, infer_content_type, stem
from ..schemas import schema
from ..session import gathered

SUFFIXES = ("md", "txt", "pdf")


def empty_files(scan: DataFrame) -> DataFrame | None:
    """(path, url, content, length) of the empty files of a scan of whole files, which Spark lists but doesn't read; None if it has none."""
    spark, listed = scan.sparkSession, scan._jdf.inputFiles()
    scan.rdd.getNumPartitions()  # plans which files are read
    planned = scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles")
    if planned.isDefined() and planned.get().value() == len(listed):
        return None
    jvm = spark._jvm  # the names don't pass through Python
    names = spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(listed), jvm.org.apache.spark.sql.Encoders.STRING())
    urls = DataFrame(names.toDF(), spark).toDF("url")
    empty = urls.join(gathered(scan).select(F.input_file_name().alias("url")), "url", "left_anti")
    path = F.regexp_replace(F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))), "^([^:/]+):///", "$1:/")
    return empty.select(path.alias("path"), "url", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length"))


def _files(spark: SparkSession, path: str, suffixes: tuple[str, ...], pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """glob_scan() with url: the path as input_file_name() has it."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    scan = (r.option("pathGlobFilter", pattern) if pattern else r).load(path)

    def known(found: DataFrame) -> DataFrame:
        found = found.filter(extension(F.col("path")).isin(*suffixes))
        return found if max_bytes is None else found.filter(F.col("length") <= max_bytes)

    found, empty = known(gathered(scan)).select("path", F.input_file_name().alias("url"), "content", "length"), empty_files(scan)
    if empty is None:
        return found
    n = max(found.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    return found.unionByName(known(empty)).coalesce(n)


def glob_scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, content, length) of files below path with a known ending, empty ones too, of max_bytes at most if that is given (larger ones are not opened)."""
    return _files(spark, path, suffixes, pattern, max_bytes).select("path", "content", "length")


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, one row for each."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, title, path, url, posted_at, content_type, metadata, text) of Markdown and text files with front matter.

    Read as bytes: the reader of whole texts makes Hadoop's settings anew for each file.
    """
    texts = _files(spark, path, ("md", "txt")).select(F.col("url").alias("path"), F.col("content").cast("string").alias("text"))
    t = texts.withColumn("f", front_matter(F.col("text")))
    meta = lambda k: F.nullif(F.try_element_at("f.metadata", F.lit(k)), F.lit(""))
    return t.select(stem(F.col("path")).alias("document_id"), document_title(F.col("f.metadata"), F.col("f.body"), F.col("path")).alias("title"), "path", meta("url").alias("url"), meta("posted_at").alias("posted_at"), F.coalesce(meta("content_type"), infer_content_type(F.col("path"))).alias("content_type"), F.col("f.metadata").alias("metadata"), F.col("f.body").alias("text"))


#: Pages, and bytes of files, after which a task passes on what it has extracted.
PAGES, PAGE_BYTES = 2048, 4 << 20


def pdf_sections(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, section_index, section, page, text) of files (path, content): a section for each page with text. extract gives a file's pages.

    A task holds one file's pages and PAGES or PAGE_BYTES of those before it.
    """
    names = ["path", "section_index", "section", "page", "text"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, data = path.as_py(), content.as_py()
                rows += [(path, k, f"Page {k + 1}", k + 1, t) for k, t in enumerate(extract(data)) if t and t.strip()]
                size += len(data)
                if rows and (len(rows) >= PAGES or size >= PAGE_BYTES):
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return files.select("path", "content").mapInArrow(run, "path string, section_index int, section string, page int, text string")


def recognise(files: DataFrame, engine: Callable[[str, str, str], dict], profiles: list[str]) -> DataFrame:
    """Each file (notice_id, file_path) with each profile through engine(path, id, profile); a failure fills `error` of its own row."""
    kind = schema("ocr_results")
    pairs = files.select("notice_id", "file_path", F.explode(F.array(*map(F.lit, profiles))).alias("preprocess_profile"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, path, profile in f[["notice_id", "file_path", "preprocess_profile"]].itertuples(index=False):
                row = dict.fromkeys(kind.names) | {"notice_id": i, "file_path": path, "preprocess_profile": profile}
                try:
                    row |= engine(path, i, profile)
                except Exception as e:  # noqa: BLE001 - an engine may fail in any way
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=kind.names)

    return pairs.mapInPandas(run, kind)


def jsonl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a JSON lines file by a schema of this engine; blank lines are left out, a bad line fails."""
    return spark.read.schema(schema(name)).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, blank lines counted."""
    t = text_scan(spark, path)
    return t.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).select("path", (F.col("line_no") + 1).alias("line_no"), "line")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with defaults; an id that is missing is q and the line's number."""
    lines = numbered_lines(spark, path).filter(~blank(F.col("line"))).withColumn("j", F.from_json("line", schema("questions"), {"mode": "FAILFAST"}))
    j = lambda c, default: F.coalesce(F.col(f"j.{c}"), F.lit(default)).alias(c)
    own = F.coalesce(F.nullif(F.col("j.question_id"), F.lit("")), F.format_string("q%03d", "line_no")).alias("question_id")
    return lines.select(own, F.col("j.question").alias("question"), j("category", ""), j("important", False), j("gold_notice_id", ""), F.coalesce("j.expected_source_keywords", F.array().cast("array<string>")).alias("expected_source_keywords"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each notice id."""
    from ..operators.layout import manifest_by_id

    lines = numbered_lines(spark, path).filter(~blank(F.col("line"))).select("line_no", F.from_json("line", schema("manifest"), {"mode": "FAILFAST"}).alias("j"))
    return manifest_by_id(lines.select("line_no", "j.*")).drop("line_no")


def ocr_results(spark: SparkSession, path: str, examples: bool = False) -> DataFrame:
    """Rows of recognised pages; files named *.example.jsonl only if examples is true."""
    rows = jsonl(spark, path, "ocr_results").withColumn("_path", F.input_file_name())
    return (rows if examples else rows.filter(~F.col("_path").endswith(".example.jsonl"))).drop("_path")


def ocr_samples(spark: SparkSession, path: str) -> DataFrame:
    t = jsonl(spark, path, "ocr_samples")
    return t.select(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "expected_features" else F.coalesce(c, F.lit("")).alias(c) for c in t.columns])


def jdbc_url(url: str, user: str = "", password: str = "") -> tuple[str, dict[str, str]]:
    """(JDBC url, properties) of a database address; postgres:// addresses are rewritten, their user and password taken out."""
    if not url.strip():
        raise ValueError("a database address is needed")
    if not url.startswith(("postgres://", "postgresql://")):
        return url, {k: v for k, v in (("user", user), ("password", password)) if v}
    u = urlsplit(url)
    whole = f"jdbc:postgresql://{u.hostname}" + (f":{u.port}" if u.port else "") + u.path + (f"?{u.query}" if u.query else "")
    return whole, {"user": user.strip() or unquote(u.username or ""), "password": password.strip() or unquote(u.password or ""), "driver": "org.postgresql.Driver"}


def jdbc_scan(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """A table of a database; partition: (column, lowest, highest, number of connections)."""
    whole, props = jdbc_url(url)
    if partition:
        c, low, high, n = partition
        return spark.read.jdbc(whole, table, column=c, lowerBound=low, upperBound=high, numPartitions=n, properties=props | properties)
    return spark.read.jdbc(whole, table, properties=props | properties)


def parse_setting(value: str) -> bool | int | float | str:
    """A scalar by what it looks like: true or false, a number, else text without its quotes."""
    bare = value.strip().strip("\"'")
    known = {"true": True, "false": False}.get(bare.lower())
    if known is not None:
        return known
    if any(c.isdigit() for c in bare):
        for kind in (int, float):
            with suppress(ValueError):
                return kind(bare)
    return bare


#: A line `key: value`, with its indent; lists, comments and other lines don't fit.
SETTING = re.compile(r"^(?P<indent> *)(?P<key>[^\s:#-][^:\n]*?) *:(?P<value>.*)$", re.M)


def setting_paths(text: str) -> dict[tuple[str, ...], str]:
    """What a file of nested `key: value` lines sets, by the path of keys; sections themselves have an empty value."""
    found: dict[tuple[str, ...], str] = {}
    above: list[tuple[int, str]] = []  # the indents and keys that a line stands below
    for m in SETTING.finditer(text):
        depth = len(m["indent"])
        above = [x for x in above if x[0] < depth] + [(depth, m["key"])]
        found[tuple(k for _, k in above)] = m["value"].strip()
    return found


def setting_rows(df: DataFrame, text_col: str) -> DataFrame:
    """A row for each setting of each row's text: df's other columns, name (keys with points between), kind and value as text."""
    kind = "array<struct<name:string,kind:string,value:string>>"

    @F.pandas_udf(kind)
    def told(texts: pd.Series) -> pd.Series:
        each = lambda t: [{"name": ".".join(p), "kind": type(x := parse_setting(v)).__name__, "value": str(x)} for p, v in setting_paths(t or "").items() if v]
        return texts.map(each)

    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.explode(told(F.col(text_col))).alias("_s")).select(*rest, "_s.name", "_s.kind", "_s.value")


def settings_file(text: str) -> dict:
    """setting_paths() as nested values; a section without any has none."""
    out: dict = {}
    paths = setting_paths(text)
    for path, value in paths.items():
        at = out
        for key in path[:-1]:
            at = at.setdefault(key, {})
        if isinstance(at, dict):
            at[path[-1]] = parse_setting(value) if value else {}
    return out


# A method's settings, as (name, type, default, where it is looked for: the first place counts).
METHOD_SETTINGS = [
    ("dataset_path", str, "", ["dataset_path"]),
    ("index_namespace", str, "", ["index_namespace"]),
    ("generation_provider", str, "mock", ["generation.provider", "generation_provider"]),
    ("generation_model", str, "demo-extractive", ["generation.model", "generation_model"]),
    ("generation_important_model", str, "", ["generation.important_model", "generation_important_model"]),
    ("prompt_version", str, "grounded_qa_v1", ["generation.prompt_version", "prompt_version"]),
    ("temperature", float, 0.0, ["generation.temperature", "temperature"]),
    ("max_output_tokens", int, 512, ["generation.max_output_tokens", "max_tokens"]),
    ("chunk_size", int, 700, ["chunk_size"]),
    ("chunk_overlap", int, 0, ["chunk_overlap"]),
    ("embedding_model", str, "hashed-256", ["embedding_model"]),
    ("embedding_dim", int, 256, ["embedding_dim"]),
    ("bm25_top_k", int, 50, ["retrieval.bm25_top_k"]),
    ("dense_top_k", int, 50, ["retrieval.dense_top_k"]),
    ("final_top_k", int, 5, ["retrieval.final_top_k"]),
    ("fusion_method", str, "rrf", ["retrieval.fusion_method"]),
    ("rrf_k", int, 60, ["retrieval.rrf_k"]),
    ("refusal_min_dense_score", float, 0.22, ["refusal_threshold.min_dense_score"]),
    ("refusal_min_token_overlap", int, 1, ["refusal_threshold.min_token_overlap"]),
    ("refusal_min_token_coverage", float, 0.3, ["refusal_threshold.min_token_coverage"]),
]


def method_config(path: str) -> dict:
    """A method's settings by METHOD_SETTINGS; the method's name is the file's unless the file gives a condition."""
    known = {".".join(p): parse_setting(v) for p, v in setting_paths(Path(path).read_text("utf-8")).items() if v}
    wanted = [("method", str, Path(path).stem, ["condition"]), *METHOD_SETTINGS]
    return {name: kind(next((known[x] for x in places if x in known), default)) for name, kind, default, places in wanted}


def valid_questions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a question isn't blank and has 500 characters at most, a session id 100."""
    ok = ~blank(F.col("question")) & (F.length("question") <= 500) & (F.length(F.coalesce("session_id", F.lit(""))) <= 100)
    ok = F.coalesce(ok, F.lit(False))
    return requests.filter(ok), requests.filter(~ok)

