"""Audit of sources: how far the term frequencies of a language's sources lie apart, by joint count histograms.

Terms are counted by (lang, source); a language keeps the terms that enough of its documents have. For each pair of
sources the combinations (count here, count there) over all kept terms are tallied, zeros included, and the distance is
evaluated once for each combination, times how many terms have it. Counting and tallying take numpy in tasks; a task of
the tally holds BLOCK sources against BLOCK others over some TERMS terms, so no task and no row stands for a pair and
term. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, handed_over, materialize, table
from .hashing import buffers
from .shards import numbered
from .tokens import coded, lowered, numbered_values, slabs, spans

#: Documents of a language that have a kept term, at least; what is added to each count; parts that a whole has; ranks of part `term`.
LEAST, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a side, and terms (about), of a task of the tally.
BLOCK, TERMS = 64, 4096
#: Bytes of text that a task is handed and counts at once; some 25 times as much is held for it.
COUNTED = 2 << 20
COUNTS = ["lang", "source", "term", "n", "df"]


def of_terms(raw: np.ndarray) -> np.ndarray:
    """Which bytes of raw, in lower case, belong to terms."""
    return (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))


def stretches(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """raw in lower case, in pieces of about size bytes that cut no term; a longer term makes its piece longer."""
    at = 0
    while at < len(raw):
        to = at + size
        while (ahead := of_terms(lowered(raw[to : to + size]))).size and ahead.all():
            to += size
        to += int(np.argmin(ahead)) if ahead.size else 0
        yield lowered(raw[at:to])
        at = to


def counted(part: pa.RecordBatch, size: int | None = None) -> pa.RecordBatch:
    """(lang, source, term, n, df) of the rows of part, once for each group and term. One text of over size (COUNTED) bytes is taken in stretches."""
    size = size or COUNTED
    raw, bounds = buffers(part.column(2))
    if part.num_rows == 1 and len(raw) > size:
        known = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for raw in stretches(raw, size):
            inside = of_terms(raw)
            start, end, _ = spans(inside, np.array([0, len(raw)]))
            code, terms = coded(raw, inside, start, end)
            more = pa.table({"term": terms, "n": np.bincount(code, minlength=len(terms)).astype(np.int64)})
            known = pa.concat_tables([known, more]).group_by("term", use_threads=False).aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"])
        terms, n = (known.column(c).combine_chunks() for c in ("term", "n"))
        lang, source = (pa.repeat(part.column(k)[0].as_py() or "", len(n)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, terms, n, pa.repeat(1, len(n))], COUNTS)
    raw = lowered(raw)
    inside = of_terms(raw)
    start, end, doc = spans(inside, bounds)
    code, terms = coded(raw, inside, start, end)
    lang, langs = numbered_values(part.column(0), "")
    source, sources = numbered_values(part.column(1), "")
    many = max(1, len(terms))
    once, n = np.unique(doc * many + code, return_counts=True)
    doc, term = np.divmod(once, many)
    key, at = np.unique((lang[doc] * len(sources) + source[doc]) * many + term, return_inverse=True)
    group, term = np.divmod(key, many)
    own = [pa.array(langs, pa.string()).take(pa.array(group // max(1, len(sources)))), pa.array(sources, pa.string()).take(pa.array(group % max(1, len(sources)))), terms.take(pa.array(term))]
    total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([*own, pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], COUNTS)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents that have the term, in each group."""

    def run(batches):
        for part in slabs(batches, 2, COUNTED):
            yield counted(part)

    found = docs.select(F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)), a long; products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = wide(n + ADDED) * F.lit(WHOLE).cast("decimal(10,0)")
    return F.call_function("div", top, wide(total + F.lit(ADDED) * terms)) + 1


def tallies(kept: DataFrame, block: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """(lang, s, t, cs, ct, m): how many terms have count cs in source s and ct in t, s < t, but for (0, 0).

    kept: (lang, sid, sources, v, term, n), sid from 0 to sources - 1 and v kept terms in the language. Terms are dealt
    to buckets; a task gets one bucket of two blocks of sources. It knows the blocks' sources by number, those without
    any of its terms too; only combinations (0, 0) are left to be implied.
    """
    own, blocks = F.call_function("div", F.col("sid"), F.lit(block)), F.call_function("div", F.col("sources") - 1, F.lit(block))
    dealt = kept.select("lang", "sid", "sources", "term", "n", F.pmod(F.xxhash64("term"), F.call_function("div", F.col("v") - 1, F.lit(terms)) + 1).alias("bucket"), own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("other"))
    dealt = dealt.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "bucket", "sid", "sources", "term", "n")

    def run(key, rows):
        lang, a, b = (k.as_py() for k in key[:3])
        last = rows.column("sources")[0].as_py()
        first, second = np.arange(a * block, min(last, (a + 1) * block)), np.arange(b * block, min(last, (b + 1) * block))
        ids = first if a == b else np.concatenate([first, second])
        term = rows.column("term").combine_chunks().dictionary_encode()
        term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
        counts = np.zeros((len(ids), len(term.dictionary)), np.int64)
        counts[np.searchsorted(ids, rows.column("sid").to_numpy()), term.indices.to_numpy()] = rows.column("n").to_numpy()
        known = [np.unique(c, return_inverse=True) for c in counts]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i in range(len(first)):
            vi, ri = known[i]
            for j in range(i + 1 if a == b else len(first), len(ids)):
                vj, rj = known[j]
                both = ri * len(vj) + rj
                if len(vi) * len(vj) <= 4 * len(both):
                    m = np.bincount(both)
                    cell = np.flatnonzero(m)
                    m = m[cell]
                else:
                    cell, m = np.unique(both, return_counts=True)
                cs, ct = vi[cell // len(vj)], vj[cell % len(vj)]
                some = (cs > 0) | (ct > 0)
                for column, x in zip(out, (np.full(some.sum(), ids[i]), np.full(some.sum(), ids[j]), cs[some], ct[some], m[some]), strict=True):
                    column.append(x)
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)], ["lang", "s", "t", "cs", "ct", "m"])

    found = dealt.groupBy("lang", "a", "b", "bucket").applyInArrow(run, "lang string, s long, t long, cs long, ct long, m long")
    return found.groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("m").alias("m"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources (part `pair`) and terms that set a source apart (`term`).

    A null text, language or source counts as ''. A source without kept terms still has its pairs; where a language
    keeps no term, its distances are 0. A language with one source has no pairs. Ties are ranked by item. Repeated rows
    and ids each count. Texts of any length are read whole. Other columns, whatever their names, are not read. An empty
    table gives no rows.
    """
    with handed_over(docs.sparkSession, COUNTED):
        counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    over = Window.partitionBy("lang", "term")  # a row for each source at most
    both = counts.select("lang", "source", "term", "n", F.sum("df").over(over).alias("df"), F.sum("n").over(over).alias("n_lang"))
    kept = materialize(both.filter(F.col("df") >= least).drop("df"), "kept-terms")
    drop(counts)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    placed = numbered(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct(), [F.col("lang"), F.col("source")])
    of_lang = placed.groupBy("lang").agg(F.min("row").alias("first"), F.count("*").alias("sources"))
    totals = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = placed.join(of_lang, "lang").join(totals, "lang", "left").join(own, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", (F.col("row") - F.col("first")).alias("sid"), "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "all", "total")]), "source-groups")
    drop(placed)
    known = kept.join(groups, ["lang", "source"])
    cells = tallies(known.select("lang", "sid", "sources", "v", "term", "n"), block, terms)
    side = lambda x: groups.select("lang", F.col("sid").alias(x), F.col("total").alias(f"total_{x}"), "v")
    cells = cells.join(side("s"), ["lang", "s"]).join(side("t").drop("v"), ["lang", "t"])
    far = F.abs(share(F.col("cs"), F.col("total_s"), F.col("v")) - share(F.col("ct"), F.col("total_t"), F.col("v")))
    told = materialize(cells.groupBy("lang", "s", "t").agg(F.sum(far * F.col("m")).alias("far"), F.sum("m").alias("m")), "distances")
    pairs = groups.select("lang", "source", "sid", "v", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sources") - 1)).alias("oid")).filter("sid <> oid")
    pairs = pairs.withColumn("s", F.least("sid", "oid")).withColumn("t", F.greatest("sid", "oid"))
    pairs = pairs.join(groups.select("lang", F.col("sid").alias("oid"), F.col("source").alias("item"), F.col("total").alias("total_o")), ["lang", "oid"]).join(told, ["lang", "s", "t"], "left")
    zero = F.lit(0).cast("long")
    none = F.abs(share(zero, F.col("total"), F.col("v")) - share(zero, F.col("total_o"), F.col("v")))
    value = F.when(F.col("v") > 0, F.coalesce("far", zero) + none * (F.col("v") - F.coalesce("m", zero))).otherwise(0).cast("long")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    apart = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("n_lang"), F.col("all"), F.col("v"))
    own_terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value")).filter("value > 0")
    return ranked.unionByName(own_terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


def _sql() -> str:
    p = lambda n, total: f"(1 + ({WHOLE}::HUGEINT * ({n} + {ADDED})) // ({total} + {ADDED} * v))"
    ranked = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank"
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS MATERIALIZED (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST}
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(a, 0) AS a, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n_lang) AS a FROM k GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
), dense AS MATERIALIZED (
  SELECT lang, source, term, n_lang, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "total")} AS p, {p("n_lang", "a")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
), own AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT *, {ranked} FROM pairs UNION ALL SELECT * FROM (SELECT *, {ranked} FROM own) WHERE rank <= {TOP}
"""


SQL = _sql()
