"""Sections and chunks of documents, without a shuffle: each document is cut by expressions on its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import CHUNK_MIN, CHUNK_TARGET
from ..functions.text import normalize, replaced, strip

_MARK, _END = "\u0001", "\u0002"


def sections(text: Column, first_name: Column | str = "Document") -> Column:
    """array of struct(section, text): lines of one to six `#`, white space and words begin a section; blank sections go."""
    clean = replaced(F.coalesce(text, F.lit("")), ["\r", _MARK, _END], f"[\r{_MARK}{_END}]", "")
    marked = replaced(clean, ["#"], r"(?md)^(#{1,6}[^\S\n]+.+)$", f"{_MARK}$1{_END}")
    pieces = F.split(marked, _MARK)
    name = F.lit(first_name) if isinstance(first_name, str) else first_name

    def one(p: Column, i: Column) -> Column:
        head = strip(F.regexp_replace(F.element_at(F.split(p, _END), 1), r"^#{1,6}\s+", ""))
        body = F.when(i == 0, p).otherwise(F.element_at(F.split(p, _END), 2))
        return F.struct(F.when(i == 0, name).otherwise(head).alias("section"), normalize(body).alias("text"))

    return F.filter(F.transform(pieces, one), lambda s: s["text"] != "")


def chunks(text: Column, size: int = CHUNK_TARGET, least: int = CHUNK_MIN, normal: bool = False) -> Column:
    """array of chunks: paragraphs are packed up to size once `least` is reached; a longer paragraph is cut hard.

    normal: text is normalised, as that of sections() is. Its paragraphs are then normal but for their ends, and so is
    what they are joined to.
    """
    hard = max(200, min(size - 80, size))
    t = text if normal else normalize(text)
    paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), empty.alias("out"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"])))

    def add(acc: Column, p: Column) -> Column:
        cut = F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{hard}}}"), F.lit(0)), strip)
        full = (F.length(acc["now"]) + F.length(p) + 2 > size) & (F.length(acc["now"]) >= least)
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.when(F.length(p) > size, F.struct(F.lit("").alias("now"), F.concat(flushed(acc), cut).alias("out"))).when(
            full, F.struct(p.alias("now"), flushed(acc).alias("out"))).otherwise(F.struct(joined.alias("now"), acc["out"].alias("out")))

    return F.aggregate(paragraphs, start, add, flushed)


def section_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_name: Column | str = "Document") -> DataFrame:
    """(document_id, section_index, section, text)"""
    out = docs.select(F.col(id_col).alias("document_id"), F.posexplode(sections(F.col(text_col), first_name)).alias("section_index", "s"))
    return out.select("document_id", "section_index", F.col("s.section").alias("section"), F.col("s.text").alias("text"))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_TARGET, first_name: Column | str = "Document", keep: list[str] | None = None) -> DataFrame:
    """(document_id, chunk_index, chunk_id, section, text, and the columns in keep). chunk_id is `document:index`."""
    cut = F.flatten(F.transform(sections(F.col(text_col), first_name), lambda s: F.transform(chunks(s["text"], size, normal=True), lambda c: F.struct(s["section"].alias("section"), c.alias("text")))))
    out = docs.select(F.col(id_col).alias("document_id"), *(keep or []), F.posexplode(cut).alias("chunk_index", "c"))
    return out.select("document_id", "chunk_index", F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("c.section").alias("section"), F.col("c.text").alias("text"), *(keep or []))


def planned_chunk_count(docs: DataFrame, text_col: str = "text", size: int = CHUNK_TARGET) -> DataFrame:
    count = F.aggregate(sections(F.col(text_col)), F.lit(0), lambda n, s: n + F.size(chunks(s["text"], size, normal=True)))
    return docs.agg(F.coalesce(F.sum(count.cast("long")), F.lit(0)).cast("long").alias("chunk_count"))
