"""Table functions for SQL: headed_sections(TABLE(...)) and packed_chunks(TABLE(...)), over (document_id, text).

They take Arrow batches and give the rows of operators.chunks for users who write SQL; document ids become text. A task
works on the batches of its own rows, and no row moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..defaults import CHUNK_MIN, CHUNK_TARGET

HEADING = re.compile(r"^#{1,6}[^\S\n]+.+$", re.M | re.A)
WHITE = " \t\n\x0b\f\r"


def tidy(text: str) -> str:
    """As functions.text.normalize()."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r", ""))).strip(WHITE)


def sections_in(text: str | None, first: str = "Document") -> list[tuple[str, str]]:
    """(section, text) of a text's sections that aren't blank, as operators.chunks.sections()."""
    clean = re.sub("[\r\x01\x02]", "", text or "")
    heads = list(HEADING.finditer(clean))
    names = [first] + [re.sub(r"^#{1,6}\s+", "", m[0], flags=re.A).strip(WHITE) for m in heads]
    bodies = [clean[a:b] for a, b in zip([0] + [m.end() for m in heads], [m.start() for m in heads] + [len(clean)], strict=True)]
    return [(n, t) for n, b in zip(names, bodies, strict=True) if (t := tidy(b))]


def chunks_in(text: str, size: int = CHUNK_TARGET, least: int = CHUNK_MIN) -> list[str]:
    """The chunks of a section's text, as operators.chunks.chunks()."""
    hard, out, held = max(200, min(size - 80, size)), [], ""
    for p in filter(None, map(tidy, re.split(r"\n\s*\n", tidy(text), flags=re.A))):
        long = len(p) > size
        if held.strip(WHITE) and (long or (len(held) + len(p) + 2 > size and len(held) >= least)):
            out.append(tidy(held))
            held = ""
        if long:
            out += [p[k : k + hard].strip(WHITE) for k in range(0, len(p), hard)]
            held = ""
        else:
            held = f"{held}\n\n{p}" if held else p
    return out + ([tidy(held)] if held.strip(WHITE) else [])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


class HeadedSections:
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = [(str(i), k, *x) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for k, x in enumerate(sections_in(t))]
        yield _table(found, ["document_id", "section_index", "section", "text"], [pa.string(), pa.int32(), pa.string(), pa.string()])


class PackedChunks:
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = []
        for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            own = [(name, c) for name, body in sections_in(t) for c in chunks_in(body)]
            found += [(str(i), k, *x) for k, x in enumerate(own)]
        yield _table(found, ["document_id", "chunk_index", "section", "text"], [pa.string(), pa.int32(), pa.string(), pa.string()])


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("headed_sections", arrow_udtf(HeadedSections, returnType="document_id string, section_index int, section string, text string"))
    spark.udtf.register("packed_chunks", arrow_udtf(PackedChunks, returnType="document_id string, chunk_index int, section string, text string"))
