"""Blocks of recognised pages: order, kinds, dates and contacts, Markdown, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, normalize, or_else, ordered_unique, safe_filename, strip

# Fixed values. The day in DATE reads one digit where it can; what it finds is kept as it is.
DATE = r"(?:(?:20\d{2})[.\-/년\s]+(?:0?[1-9]|1[0-2])[.\-/월\s]+(?:0?[1-9]|[12]\d|3[01])(?:일)?)|(?:(?:0?[1-9]|1[0-2])[.\-/월\s]+(?:0?[1-9]|[12]\d|3[01])(?:일)?)"
PHONE = r"(?:0\d{1,2}[-.)\s]?\d{3,4}[-.\s]?\d{4})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BLOCK_TYPES = ["title", "body", "table", "date", "contact", "unknown"]
#: With the two-digit days first; not the default.
DATE_WHOLE_DAYS = DATE.replace("(?:0?[1-9]|[12]\\d|3[01])(?:일)?", "(?:3[01]|[12]\\d|0?[1-9])(?:일)?")

BLOCK = "struct<text:string,bbox:array<double>,confidence:double,page:int,block_type:string>"


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip)


def dates(text: Column, whole_days: bool = False) -> Column:
    return ordered_unique(_found(text, DATE_WHOLE_DAYS if whole_days else DATE))


def contacts(text: Column) -> Column:
    """Phone numbers, then mail addresses."""
    return ordered_unique(F.concat(_found(text, PHONE), _found(text, EMAIL)))


def polygon_bbox(points: Column) -> Column:
    """[min x, min y, max x, max y] of an array of [x, y]; zeros if there are no points."""
    x, y = F.transform(points, lambda p: F.get(p, 0).cast("double")), F.transform(points, lambda p: F.get(p, 1).cast("double"))
    zero = F.array(*[F.lit(0.0)] * 4)
    return F.when(F.size(points) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))).otherwise(zero)


def normalize_bbox(bbox: Column) -> Column:
    first = F.slice(bbox, 1, 4)
    whole = (F.size(bbox) >= 4) & F.forall(first, lambda v: v.isNotNull())
    return F.when(whole, first).otherwise(F.array(*[F.lit(0.0)] * 4))


def looks_like_table(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~blank(x))
    marked = (F.size(lines) >= 2) & F.exists(lines, lambda x: F.contains(strip(x), F.lit("\t")) | F.contains(x, F.lit("|")))
    return marked | (F.size(F.regexp_extract_all(text, F.lit(r"\s{2,}"), F.lit(0))) >= 3)


def block_type(text: Column, raw: Column, confidence: Column) -> Column:
    kind = F.lower(strip(F.coalesce(raw, F.lit("unknown"))))
    return (
        F.when(kind.isin("title", "table"), kind)
        .when(F.size(contacts(text)) > 0, "contact")
        .when((F.size(dates(text)) > 0) & (F.length(text) <= 80), "date")
        .when(looks_like_table(text), "table")
        .when(kind.isin("body", "text"), "body")
        .when(confidence <= 0, "unknown")
        .otherwise("body")
    )


def _cells(line: Column) -> Column:
    piped = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)
    tabbed = F.transform(F.split(line, "\t"), strip)
    spaced = F.filter(F.transform(F.split(line, r"\s{2,}"), strip), lambda c: c != "")
    return F.when(F.contains(line, F.lit("|")), piped).when(F.contains(line, F.lit("\t")), tabbed).otherwise(spaced)


def table_markdown(text: Column) -> Column:
    """A Markdown table of rows and cells, or of `key: value` lines; other text as it is."""
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: ~blank(x)), strip)
    rows = F.transform(lines, _cells)
    width = F.array_max(F.transform(rows, F.size))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: row(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
    rule = row(F.array_repeat(F.lit("---"), width.cast("int")))
    grid = F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, 1_000_000)), "\n")
    pairs = F.filter(F.when(F.size(lines) > 0, lines).otherwise(F.array(text)), lambda x: F.contains(x, F.lit(":")))
    named = F.transform(pairs, lambda x: F.concat(F.lit("| "), strip(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 1)), F.lit(" | "), strip(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 2)), F.lit(" |")))
    keyed = F.array_join(F.concat(F.array(F.lit("| 항목 | 값 |"), F.lit("| --- | --- |")), named), "\n")
    return F.when((F.size(lines) >= 2) & (width >= 2), grid).when(F.size(pairs) > 0, keyed).otherwise(text)


def block_markdown(text: Column, kind: Column) -> Column:
    return F.when(kind == "table", table_markdown(text)).when(kind == "title", F.concat(F.lit("# "), text)).otherwise(text)


def reading_order(blocks: Column) -> Column:
    """Blocks by page, top and left; blocks at one place keep their order."""
    page = lambda b: F.when(F.coalesce(b["page"], F.lit(0)) == 0, 1).otherwise(b["page"])
    keyed = F.transform(blocks, lambda b, i: F.struct(page(b).alias("p"), F.get(normalize_bbox(b["bbox"]), 1).alias("y"), F.get(normalize_bbox(b["bbox"]), 0).alias("x"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda k: k["b"])


def inferred_title(metadata_title: Column, title: Column, notice_title: Column, notice_id: Column) -> Column:
    return or_else(metadata_title, title, notice_title, F.concat(F.lit("Layout-aware OCR - "), or_else(notice_id, F.lit("ocr_notice"))))


def manifest_by_id(manifest: DataFrame, order: str = "line_no") -> DataFrame:
    """The last row of each id; rows without an id go."""
    rest = F.struct(*manifest.columns)
    return manifest.filter(~blank(F.col("notice_id"))).groupBy("notice_id").agg(F.max_by(rest, order).alias("r")).select("r.*")


def layout_chunks(results: DataFrame, manifest: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """A row for each block with text, in reading order (counted before blank blocks go).

    results: (notice_id, file_path, ocr_engine, engine_version, preprocess_profile, title, url, posted_at, metadata
    map, blocks array); manifest: (notice_id, title, url, posted_at), each id once.
    """
    m = manifest.select("notice_id", F.col("title").alias("m_title"), F.col("url").alias("m_url"), F.col("posted_at").alias("m_posted"))
    r = results.join(m, "notice_id", "left")
    b = r.select("*", F.posexplode(reading_order(F.col("blocks"))).alias("pos", "b")).withColumn("text", normalize(F.coalesce("b.text", F.lit("")))).filter("text <> ''")
    confidence = F.coalesce("b.confidence", F.lit(0.0))
    page = F.when(F.coalesce("b.page", F.lit(0)) == 0, 1).otherwise(F.col("b.page"))
    b = b.withColumn("confidence", confidence).withColumn("block_type", block_type(F.col("text"), F.col("b.block_type"), F.col("confidence"))).withColumn("page", page).withColumn("reading_order", F.col("pos") + 1)
    low = F.when(F.col("confidence") < min_confidence, F.lit("[LOW_CONFIDENCE]\n")).otherwise("")
    return b.select(
        F.concat(F.lit("layout_"), safe_filename(or_else(F.col("notice_id"), F.lit("notice"))), F.lit("_"), F.col("page").cast("string"), F.lit("_"), F.format_string("%04d", "reading_order")).alias("chunk_id"),
        "notice_id", F.col("file_path").alias("source_image_path"), "ocr_engine", "engine_version", "preprocess_profile", "block_type", normalize_bbox(F.col("b.bbox")).alias("bbox"), "page", "reading_order", "confidence",
        inferred_title(F.try_element_at("metadata", F.lit("title")), F.col("title"), F.col("m_title"), F.col("notice_id")).alias("title"),
        or_else(F.col("url"), F.col("m_url")).alias("url"), or_else(F.col("posted_at"), F.col("m_posted")).alias("posted_at"),
        dates(F.col("text")).alias("extracted_dates"), contacts(F.col("text")).alias("extracted_contacts"), "text",
        F.concat(low, block_markdown(F.col("text"), F.col("block_type"))).alias("markdown_text"))


def plain_documents(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Results with plain text, as documents with front matter."""
    m = manifest.select("notice_id", F.col("title").alias("m_title"), F.col("url").alias("m_url"), F.col("posted_at").alias("m_posted"))
    r = results.filter(~blank(F.col("plain_text"))).join(m, "notice_id", "left")
    title = or_else(F.try_element_at("metadata", F.lit("title")), F.col("title"), F.col("m_title"), F.concat(F.lit("OCR plain text - "), or_else(F.col("notice_id"), F.lit("ocr_notice"))))
    return r.select("notice_id", "file_path", "ocr_engine", title.alias("title"), or_else(F.col("url"), F.col("m_url")).alias("url"), or_else(F.col("posted_at"), F.col("m_posted")).alias("posted_at"), normalize(F.col("plain_text")).alias("text"), F.lit("image_ocr_plain").alias("content_type"))


def _front(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("")), F.lit("\n")) for k, v in pairs], F.lit("---\n\n"))


def _number(v: Column) -> Column:
    return v.cast("string")


def _json(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))


def _quoted(v: Column) -> Column:
    one = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ", "), F.lit("]"))


def chunk_document(chunks: DataFrame) -> DataFrame:
    """layout_chunks() with `document`: the chunk as Markdown with front matter."""
    c = F.col
    front = _front([(k, c(k)) for k in ("notice_id", "source_image_path", "ocr_engine", "engine_version", "preprocess_profile")] + [("content_type", F.lit("image_ocr_layout_chunk")), ("block_type", c("block_type")), ("bbox", _json(c("bbox"))), ("page", _number(c("page"))), ("reading_order", _number(c("reading_order"))), ("confidence", _number(c("confidence"))), ("title", c("title")), ("url", c("url")), ("posted_at", c("posted_at")), ("extracted_dates", _quoted(c("extracted_dates"))), ("extracted_contacts", _quoted(c("extracted_contacts")))])
    body = F.concat(F.lit("# "), c("title"), F.lit("\n\n- block_type: "), c("block_type"), F.lit("\n- reading_order: "), _number(c("reading_order")), F.lit("\n- confidence: "), F.format_string("%.4f", c("confidence")), F.lit("\n- bbox: "), _json(c("bbox")), F.lit("\n\n"), c("markdown_text"), F.lit("\n"))
    return chunks.withColumn("document", F.concat(front, body))


def plain_document(docs: DataFrame) -> DataFrame:
    c = F.col
    front = _front([(k, c(k)) for k in ("notice_id", "file_path", "ocr_engine", "content_type", "title", "url", "posted_at")])
    return docs.withColumn("document", F.concat(front, F.lit("# "), c("title"), F.lit("\n\n"), c("text"), F.lit("\n")))


def block_type_counts(chunks: DataFrame) -> DataFrame:
    """(block_type, n) of all kinds, 0 for those that don't occur."""
    kinds = chunks.sparkSession.createDataFrame([(k,) for k in BLOCK_TYPES], "block_type string")
    n = chunks.groupBy("block_type").agg(F.count("*").alias("n"))
    return kinds.join(n, "block_type", "left").select("block_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def index_metadata(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: counts by content type, low confidence, sorted distinct dates and contacts.

    documents: (document_id, content_type, chunk_count).
    """
    d = documents.agg(F.count("*").alias("document_count"), F.count_if(F.col("content_type") == "text").alias("text_document_count"), F.count_if(F.col("content_type") == "image_ocr_layout_chunk").alias("layout_chunk_document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunk_count"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    k = chunks.agg(F.count("*").alias("layout_chunk_count"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence_chunk_count"), every("extracted_dates").alias("extracted_dates"), every("extracted_contacts").alias("extracted_contacts"))
    return d.crossJoin(k)  # one row each


def found_values(chunks: DataFrame) -> DataFrame:
    """(found, kind): the distinct dates and contacts of chunks (extracted_dates, extracted_contacts), a row for each, whatever their number."""
    of = lambda c, kind: chunks.select(F.explode(c).alias("found"), F.lit(kind).alias("kind"))
    return of("extracted_dates", "date").unionByName(of("extracted_contacts", "contact")).distinct()


def corpus(text_docs: DataFrame, *others: DataFrame) -> DataFrame:
    """The union of document tables by name; columns that one lacks are null there."""
    out = text_docs
    for t in others:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def engine_summary(results: DataFrame) -> DataFrame:
    """Successes, failures, mean time and mean confidence for each engine and profile. results: (ocr_engine, preprocess_profile, error, elapsed_seconds, blocks)."""
    r = results.withColumn("conf", F.expr("aggregate(blocks, cast(0.0 as double), (a, b) -> a + b.confidence) / nullif(size(blocks), 0)"))
    ok = F.col("error").isNull()
    return r.groupBy("ocr_engine", "preprocess_profile").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("elapsed_seconds"))), 6).alias("avg_elapsed_seconds"), F.round(F.avg(F.when(ok, F.col("conf"))), 6).alias("avg_confidence"))
