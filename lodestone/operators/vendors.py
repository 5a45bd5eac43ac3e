"""Answers of recognition engines, read as VARIANT and brought to one form of blocks. Expressions only.

Four shapes are known: `fields` (images with fields that have a text, a confidence and a polygon), `pages` (pages of
lines [polygon, [text, confidence]]), `lines` (lines [polygon, text, confidence]) and `regions` (objects with a bbox, a
kind, and a text or a list of parts). What doesn't fit its shape gives a row with an error and no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import polygon_bbox

BLOCKS = "array<struct<text:string,bbox:array<double>,confidence:double,block_type:string>>"
#: Kinds of regions that are kept; others are `unknown`. Fixed values.
KINDS = ["text", "title", "table"]
MANY = "array<variant>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _block(text: Column, bbox: Column, confidence: Column, kind: Column | str = "text") -> Column:
    return F.struct(strip(text).alias("text"), bbox.alias("bbox"), confidence.alias("confidence"), (F.lit(kind) if isinstance(kind, str) else kind).alias("block_type"))


def _some(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(MANY))


def _fields(v: Column) -> tuple[Column, Column]:
    """(blocks, whether all fits); a field's missing parts are empty, 0 and zeros."""

    def one(f: Column) -> Column:
        points = F.transform(_some(_get(f, "$.boundingPoly.vertices", MANY)), lambda p: F.array(*[F.coalesce(_get(p, f"$.{c}", "double"), F.lit(0.0)) for c in "xy"]))
        return _block(F.coalesce(_get(f, "$.inferText", "string"), F.lit("")), polygon_bbox(points), F.coalesce(_get(f, "$.inferConfidence", "double"), F.lit(0.0)))

    images = _some(_get(v, "$.images", MANY))
    return F.flatten(F.transform(images, lambda i: F.transform(_some(_get(i, "$.fields", MANY)), one))), _get(v, "$", "map<string,variant>").isNotNull()


def _lines(lines: Column, text: str, confidence: str) -> tuple[Column, Column]:
    """Lines whose polygon comes first; all three parts have to be there."""
    points = lambda x: _get(x, "$[0]", "array<array<double>>")
    whole = lambda x: points(x).isNotNull() & (F.size(points(x)) > 0) & F.forall(F.coalesce(points(x), F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2) & _get(x, text, "string").isNotNull() & _get(x, confidence, "double").isNotNull()
    return F.transform(lines, lambda x: _block(_get(x, text, "string"), polygon_bbox(points(x)), _get(x, confidence, "double"))), F.forall(lines, whole)


def _regions(v: Column) -> tuple[Column, Column]:
    def one(r: Column) -> Column:
        parts = _get(r, "$.res", MANY)
        joined = F.array_join(F.transform(F.filter(_some(parts), lambda p: _get(p, "$", "map<string,variant>").isNotNull()), lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit(""))), " ")
        kind = _get(r, "$.type", "string")
        box = _get(r, "$.bbox", "array<double>")
        return _block(F.when(parts.isNotNull(), joined).otherwise(F.coalesce(_get(r, "$.res", "string"), F.lit(""))), F.when(F.size(box) > 0, box).otherwise(F.array(*[F.lit(0.0)] * 4)), F.coalesce(_get(r, "$.confidence", "double"), F.lit(0.0)), F.when(kind.isin(KINDS), kind).otherwise("unknown"))

    regions = _get(v, "$", MANY)
    return F.transform(_some(regions), one), regions.isNotNull() & F.forall(_some(regions), lambda r: _get(r, "$", "map<string,variant>").isNotNull())


def decoded(answers: DataFrame, shape_col: str = "shape", answer_col: str = "answer") -> DataFrame:
    """answers with error, blocks and plain_text (the blocks' texts by line). blocks is empty where there is an error.

    Errors: NO_ANSWER (null), NOT_JSON, UNKNOWN_SHAPE, MALFORMED. Texts of any length and any number of blocks are read;
    other columns stay.
    """
    v, shape = F.col("_v"), F.col(shape_col)
    pages = F.flatten(F.transform(_some(_get(v, "$", MANY)), lambda p: _some(_get(p, "$", MANY))))
    known = {"fields": _fields(v), "pages": _lines(pages, "$[1][0]", "$[1][1]"), "lines": _lines(_some(_get(v, "$", MANY)), "$[1]", "$[2]"), "regions": _regions(v)}
    listed = _get(v, "$", MANY).isNotNull() | F.is_variant_null(v)
    blocks, fits = F.lit(None).cast(BLOCKS), F.lit(None).cast("boolean")
    for name, (own, ok) in known.items():
        blocks, fits = F.when(shape == name, own.cast(BLOCKS)).otherwise(blocks), F.when(shape == name, ok & (listed if name in ("pages", "lines") else F.lit(True))).otherwise(fits)
    out = answers.withColumn("_v", F.try_parse_json(answer_col)).withColumn("blocks", blocks)
    error = F.when(F.col(answer_col).isNull(), "NO_ANSWER").when(v.isNull(), "NOT_JSON").when(~F.coalesce(shape.isin(list(known)), F.lit(False)), "UNKNOWN_SHAPE").when(~F.coalesce(fits, F.lit(False)), "MALFORMED")
    out = out.withColumn("error", error).withColumn("blocks", F.when(F.col("error").isNull(), F.col("blocks")).otherwise(F.array().cast(BLOCKS))).drop("_v")
    return out.withColumn("plain_text", F.array_join(F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: t != ""), "\n"))
