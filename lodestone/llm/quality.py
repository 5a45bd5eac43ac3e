"""Quality rules with thresholds that adapt to language and source, in DataFrame functions only.

A text's measures are whole numbers: word length, symbols, repeated lines and repeated words in proportion. Of each
measure, (lang, source) group keeps a mergeable quantile sketch: counts in buckets whose width grows with the value
(exact below 64, then 32 buckets for each doubling, so a quantile is off by 1/32 of itself at most). Sketches merge by
adding counts, so a language's sketch is the sum of its sources' and the corpus's that of its languages'. Fences come
from the quantiles of the sketch, and a join brings them back to the documents. A group with fewer than LEAST documents
takes its language's fences, a language with fewer the corpus's, and a corpus with fewer has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, materialize, table

#: Base rules: words at least, words of a window, percent of words in repeated windows at most.
WORDS, WINDOW, REPEATED = 10, 5, 20
#: Documents of a group from which its own quantiles count.
LEAST = 50
#: A fence lies SPREAD times the way from the median to the outer decile beyond that decile, or the measure's slack if that is more.
SPREAD = 3
#: (measure, slack, whether small values are fenced too). Word length in hundredths of a character, the others for 1000 words or lines; a sentence
#: that a short text has twice is within the slack.
MEASURES = [("length", 150, True), ("symbols", 150, False), ("dup_lines", 300, False), ("repeated", 180, False)]
WHITE = r"\x20\x09-\x0D"


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """A row for each row of docs: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows of a text are equal if their 64-bit hashes are; only windows of one text are compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{WHITE}]")))
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(by[0]).alias("lang"), F.col(by[1]).alias("source"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.array_remove(plain, "").alias("words"), lines.alias("lines"))
    own = ["doc_id", "lang", "source", "n_symbols"]
    m = m.select(
        *own, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    own += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    whole = F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))
    runs = F.slice(F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])), F.lit(1), whole)
    m = m.select(*own, runs.alias("runs"))
    #: Only texts with a window twice go on: their windows by hash and place.
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    placed = F.when(twice, F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    m = m.select(*own, placed.alias("placed"))
    equal = F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]))
    m = m.select(*own, F.sort_array(F.transform(equal, lambda x: x["i"])).alias("at"))
    new = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW))))
    return m.select(*own, F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def judged_by_base(m: DataFrame) -> DataFrame:
    """m with base_failed, and the MEASURES of texts that pass (null for the others)."""
    failed = (F.col("n_words") < WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    each = lambda x, of, unit: F.when(~failed, _div(F.col(x) * unit, F.greatest(F.col(of), F.lit(1))))
    return m.select("*", failed.alias("base_failed"), each("word_chars", "n_words", 100).alias("length"), each("n_symbols", "n_words", 1000).alias("symbols"), each("n_dup_lines", "n_lines", 1000).alias("dup_lines"), each("n_repeat_words", "n_words", 1000).alias("repeated"))


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32).cast("long") + F.call_function("shiftright", v, e)


def bounds(b: Column) -> tuple[Column, Column]:
    """The smallest and the largest number of a bucket."""
    e = F.greatest(_div(b, F.lit(32)) - 1, F.lit(0)).cast("int")
    one = F.lit(1).cast("long")
    low = F.call_function("shiftleft", b - e * 32, e)
    return low, low + F.call_function("shiftleft", one, e) - 1


def sketches(judged: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the texts that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(name)).alias("bucket")) for k, (name, _, _) in enumerate(MEASURES)])
    return judged.filter("not base_failed").select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of groups, merged to those of keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """(*keys, low_0, high_0, ...) for each group of at least so many documents; no low for measures without one."""
    own = Window.partitionBy(*keys, "measure")
    s = sketch.select(*keys, "measure", "bucket", F.sum("n").over(own.orderBy("bucket")).alias("upto"), F.sum("n").over(own).alias("all")).filter(F.col("all") >= least)
    lower, upper = bounds(F.col("bucket"))
    s = s.withColumn("lower", lower).withColumn("upper", upper)
    at = lambda k, tenths, side: F.min(F.when((F.col("measure") == k) & (F.col("upto") * 10 >= F.col("all") * tenths), F.col(side)))
    out = []
    for k, (_, slack, both) in enumerate(MEASURES):
        d1, mid_low, mid_high, d9 = at(k, 1, "lower"), at(k, 5, "lower"), at(k, 5, "upper"), at(k, 9, "upper")
        out.append((d9 + F.greatest((d9 - mid_low) * SPREAD, F.lit(slack))).cast("long").alias(f"high_{k}"))
        out.append(((d1 - F.greatest((mid_high - d1) * SPREAD, F.lit(slack))) if both else F.lit(None)).cast("long").alias(f"low_{k}"))
    return s.groupBy(*keys).agg(*out) if keys else s.groupBy().agg(*out)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), least: int = LEAST) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, outside.

    outside names the measures beyond their fences, with commas between. A null or empty text has no words and fails the
    base rules. Null languages and sources are groups of their own, as any value. Repeated rows and ids each get a row
    and each count in the sketches. Texts of any length are measured whole; values on a fence are inside. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    m = materialize(judged_by_base(measured(docs, id_col, text_col, by)), "measured")
    sketch = materialize(sketches(m), "sketches")
    levels = [["lang", "source"], ["lang"], []]
    found = [fences(merged(sketch, keys) if keys != levels[0] else sketch, keys, least) for keys in levels]
    #: A row for each group that has a document, so that the documents themselves meet one table only.
    groups = m.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    sides = [f"{side}_{k}" for k in range(len(MEASURES)) for side in ("low", "high")]
    for i, (keys, f) in enumerate(zip(levels, found, strict=True)):
        f = f.select(*[F.col(c).alias(f"{c}_{i}") for c in f.columns])
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_{i}"))
        groups = groups.join(f, same, "left") if keys else groups.crossJoin(f)  # the last is one row
    #: A group's fences come from one level: the first that has any.
    level = F.when(F.col("high_0_0").isNotNull(), 0).when(F.col("high_0_1").isNotNull(), 1).otherwise(2)
    of = lambda c: F.when(level == 0, F.col(f"{c}_0")).when(level == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(c)
    told = materialize(groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[of(c) for c in sides]), "fences")
    drop(sketch)
    out = m.join(told, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    beyond = [F.when((F.col(name) > F.col(f"high_{k}")) | F.coalesce(F.col(name) < F.col(f"low_{k}"), F.lit(False)), F.lit(name)) for k, (name, _, _) in enumerate(MEASURES)]
    outside = F.concat_ws(",", *beyond)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (outside == "")).alias("kept"), outside.alias("outside"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of docs whose id and text quality() keeps, with all their columns, whatever their names; null ids too.

    Rows of one id are told apart by their measures. An empty table stays empty.
    """
    from .common import fresh

    rid = fresh(docs, "_rid")
    numbered = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "quality-rows")
    keep = quality(numbered, rid, text_col, by).filter("kept").select(F.col("doc_id").alias(rid))
    return numbered.join(keep, rid, "left_semi").drop(rid)


def op13_adaptive_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    n = len(MEASURES)
    at = lambda k, tenths, side: f"min(CASE WHEN measure = {k} AND upto * 10 >= total * {tenths} THEN {side} END)"
    fence, choose, beyond = [], [], []
    for k, (name, slack, both) in enumerate(MEASURES):
        high = f"{at(k, 9, 'upper_')} + greatest(({at(k, 9, 'upper_')} - {at(k, 5, 'lower_')}) * {SPREAD}, {slack})"
        low = f"{at(k, 1, 'lower_')} - greatest(({at(k, 5, 'upper_')} - {at(k, 1, 'lower_')}) * {SPREAD}, {slack})" if both else "NULL"
        fence.append(f"({high})::BIGINT AS high_{k}, ({low})::BIGINT AS low_{k}")
        choose += [f"CASE WHEN a.high_0 IS NOT NULL THEN a.{s}_{k} WHEN b.high_0 IS NOT NULL THEN b.{s}_{k} ELSE c.{s}_{k} END AS {s}_{k}" for s in ("low", "high")]
        beyond.append(f"CASE WHEN {name} > high_{k} OR {name} < low_{k} THEN '{name}' END")
    cells = ", ".join(f"struct_pack(measure := {k}, v := {name})" for k, (name, _, _) in enumerate(MEASURES))
    level = lambda keys: f"""SELECT {keys} {', '.join(fence)} FROM (
      SELECT *, (bucket - 32 * e) << e AS lower_, ((bucket - 32 * e + 1) << e) - 1 AS upper_ FROM (
        SELECT *, greatest(bucket // 32 - 1, 0)::BIGINT AS e, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS total
        FROM (SELECT {keys} measure, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL))) WHERE total >= {LEAST} {f'GROUP BY {keys.rstrip(", ")}' if keys else ''}"""  # noqa: E731
    return rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{WHITE}]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{WHITE}]')) AS ls FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM t)
), rep AS (
  SELECT rid, count(DISTINCT j)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1) GROUP BY rid
), m AS MATERIALIZED (
  SELECT *, CASE WHEN NOT base_failed THEN word_chars * 100 // greatest(n_words, 1) END AS length, CASE WHEN NOT base_failed THEN n_symbols * 1000 // greatest(n_words, 1) END AS symbols,
    CASE WHEN NOT base_failed THEN n_dup_lines * 1000 // greatest(n_lines, 1) END AS dup_lines, CASE WHEN NOT base_failed THEN n_repeat_words * 1000 // greatest(n_words, 1) END AS repeated
  FROM (SELECT *, n_words < {WORDS} OR n_repeat_words * 100 > n_words * {REPEATED} AS base_failed FROM (
    SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep USING (rid)))
), sketch AS MATERIALIZED (
  SELECT lang, source, x.measure AS measure, greatest(length(bin(x.v)) - 6, 0) * 32 + (x.v >> greatest(length(bin(x.v)) - 6, 0)) AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest([{cells}]) AS x FROM m WHERE NOT base_failed) GROUP BY ALL
), a AS ({level('lang, source, ')}), b AS ({level('lang, ')}), c AS ({level('')}),
f AS (
  SELECT g.lang, g.source, {', '.join(choose)} FROM (SELECT DISTINCT lang, source FROM m) g
  LEFT JOIN a ON a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON b.lang IS NOT DISTINCT FROM g.lang LEFT JOIN c ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, outside FROM (
  SELECT m.*, concat_ws(',', {', '.join(beyond)}) AS outside FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
"""


SQL = _sql()
