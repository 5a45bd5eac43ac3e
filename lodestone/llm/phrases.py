"""Collocations: phrases whose words occur together more than apart, by sorting packed n-grams of frequent words.

Texts are cut into words once and stored as slabs: the distinct words of some megabytes of text, and a stream of their
codes. Words that occur often enough in their language are numbered (the dictionary); each slab learns the numbers of
its own words only, by a join. A stream then gives a key for each place: the numbers of the word there and of up to
three that follow, packed in a fixed width, cut off at the piece's end and at any other word. Keys are counted within a
slab, dealt by range, sorted by radix and counted by the lengths of runs; since a phrase is a prefix of keys, the same
sorted keys give the counts of phrases of two, three and four words. Only the first and the last run of a range may go
on elsewhere, and are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, table
from .hashing import buffers
from .shards import numbered
from .tokens import coded, lowered, numbered_values, slabs, spans

#: Words of a phrase at most; occurrences of a candidate at least; percent of a phrase's occurrences that a longer one has when it goes; phrases of a language.
LONGEST, LEAST, SHARED, TOP = 4, 30, 80, 2000
#: Twice the score of a phrase whose words never occur apart.
UNIT = 2_000_000
#: Bytes of text of a slab; keys of a range, about.
SLAB, RANGE = 8 << 20, 2_000_000
BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
BLANKS = [0x20, 0x09]
IDS = [f"i{k}" for k in range(LONGEST)]


def _among(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


def word_slabs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SLAB) -> DataFrame:
    """(slab, langs, words, counts, stream): a row for each slab of texts.

    Number k of langs, words and counts is the slab's word of code k: its language, text and occurrences. stream has 32
    bits for each word of the texts in order: twice its code, plus one where a piece begins.
    """
    breaks, outside = _among(BREAKS), _among(BREAKS + BLANKS)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for part in slabs(batches, 1, size):
            raw, bounds = buffers(part.column(1))
            raw = lowered(raw)
            inside = ~outside[raw]
            start, end, doc = spans(inside, bounds)
            code, words = coded(raw, inside, start, end)
            lang, langs = numbered_values(part.column(0), "und")
            key, own, n = np.unique(lang[doc] * max(1, len(words)) + code, return_inverse=True, return_counts=True)
            passed = np.concatenate([[0], np.cumsum(breaks[raw])])[start]
            begins = np.ones(len(start), bool)
            begins[1:] = (passed[1:] != passed[:-1]) | (doc[1:] != doc[:-1])
            stream = (own.astype(np.uint32) << 1) | begins
            of, word = np.divmod(key, max(1, len(words)))
            lists = [pa.array(langs, pa.string()).take(pa.array(of)), words.take(pa.array(word)), pa.array(n.astype(np.int64))]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *whole, pa.array([stream.astype("<u4").tobytes()], pa.binary())], ["slab", "langs", "words", "counts", "stream"])
            number += 1

    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "slab long, langs array<string>, words array<string>, counts array<long>, stream binary")


def radix_order(columns: list[np.ndarray], width: int) -> np.ndarray:
    """The order that sorts rows by columns, the first most: stable sorts by 16 bits, the last first. Numbers have width bytes."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in range(0, 8 * width, 16):
            digit = ((c >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
            order = order[np.argsort(digit, kind="stable")]
    return order


def counted_runs(columns: list[np.ndarray], n: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows in order, the sum of n for each)."""
    if not len(n):
        return columns, n
    order = radix_order(columns, width)
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at)


def packed(columns: list[np.ndarray], width: int) -> pa.Array:
    """Rows of numbers as binary keys whose order is that of the numbers."""
    whole = np.stack([c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :] for c in columns], 1).reshape(len(columns[0]), -1)
    edges = np.arange(len(whole) + 1, dtype=np.int32) * (len(columns) * width)
    return pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(whole))])


def unpacked(keys: pa.Array, width: int, columns: int = LONGEST) -> list[np.ndarray]:
    _, edges, data = keys.buffers()
    first = int(np.frombuffer(edges, np.int32)[keys.offset])
    wide = np.zeros((len(keys), columns, 8), np.uint8)
    wide[:, :, 8 - width :] = np.frombuffer(data, np.uint8)[first : first + len(keys) * columns * width].reshape(len(keys), columns, width)
    return [wide[:, k].copy().view(">u8").reshape(-1).astype(np.uint64) for k in range(columns)]


def packed_phrases(held: DataFrame, dictionary: DataFrame, width: int) -> DataFrame:
    """(key, n): the keys of each slab, counted. dictionary: (lang, word, id), ids from 1 and of width bytes."""
    words = held.select("slab", F.posexplode(F.arrays_zip("langs", "words")).alias("code", "w")).select("slab", "code", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    own = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("slab").agg(F.collect_list("code").alias("codes"), F.collect_list("id").alias("ids"))  # as many as the slab has words

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch.column(0)[k].as_py(), "<u4")
                codes, ids = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
                known = np.zeros(1 << 16 if not len(raw) else int(raw.max() // 2) + 1, np.uint64)
                known[codes] = ids
                now = known[raw >> 1]
                columns, going = [now], now > 0
                for j in range(1, LONGEST):
                    step = np.zeros(len(now), np.uint64)
                    step[: len(now) - j] = np.where((raw[j:] & 1) == 0, now[j:], 0)
                    going = going & (step > 0)
                    columns.append(np.where(going, step, 0).astype(np.uint64))
                some = columns[1] > 0
                columns, n = counted_runs([c[some] for c in columns], np.ones(int(some.sum()), np.int64), width)
                for at in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([packed([c[at : at + 100_000] for c in columns], width), pa.array(n[at : at + 100_000])], ["key", "n"])

    return held.select("slab", "stream").join(own, "slab").select("stream", "codes", "ids").mapInArrow(run, "key binary, n long")


def phrase_counts(keys: DataFrame, width: int, least: int = LEAST, per_range: int = RANGE) -> DataFrame:
    """(i0, i1, i2, i3, size, n): the phrases that keys have at least so many times; places beyond size are 0."""
    ranges = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // per_range))

    def run(batches):
        got = [(batch.column(0), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if not got:
            return
        columns = [np.concatenate(c) for c in zip(*(unpacked(k, width) for k, _ in got), strict=True)]
        columns, n = counted_runs(columns, np.concatenate([n for _, n in got]), width)
        differs = np.zeros(len(n), bool)
        differs[0] = True
        for size in range(1, LONGEST + 1):
            differs[1:] |= columns[size - 1][1:] != columns[size - 1][:-1]
            if size == 1:
                continue
            at = np.flatnonzero(differs)
            total = np.add.reduceat(n, at)
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True
            pick = (columns[size - 1][at] > 0) & (edge | (total >= least))
            ids = [pa.array((columns[k][at][pick] if k < size else np.zeros(pick.sum())).astype(np.int64)) for k in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(pick.sum(), size, np.int32)), pa.array(total[pick]), pa.array(edge[pick])], [*IDS, "size", "n", "edge"])

    runs = materialize(keys.repartitionByRange(ranges, "key").mapInArrow(run, ", ".join(f"{i} long" for i in IDS) + ", size int, n long, edge boolean"), "phrase-runs")
    whole = runs.filter("not edge").drop("edge")
    cut = runs.filter("edge").groupBy(*IDS, "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return whole.unionByName(cut)


def _part(begin: Column, length: Column) -> list[Column]:
    """The ids of the words from begin on, so many of them, as columns; 0 beyond."""
    return [F.when(F.lit(k) < length, F.coalesce(F.get(F.array(*IDS), begin + k), F.lit(0))).otherwise(0).cast("long") for k in range(LONGEST)]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, shared: int = SHARED, top: int = TOP, slab: int = SLAB, per_range: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A null or empty text has no words; a null language counts as `und`. Ties go by a, then by the phrase. Repeated rows
    and ids each count. Texts of any length are read whole. Other columns, whatever their names, are not read. A
    language without candidates has no rows, nor has an empty table.
    """
    held = materialize(word_slabs(docs, text_col, lang_col, slab), "slabs", **{"parquet.page.size.row.check.min": "4"})
    words = held.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).select(F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("all"))
    placed = numbered(words.filter(F.col("n") >= least), [F.col("lang"), F.col("word")])
    width = max(1, -(-int(placed._rows).bit_length() // 8))
    dictionary = placed.select("lang", "word", "n", (F.col("row") + 1).alias("id"))
    keys = materialize(packed_phrases(held, dictionary, width), "phrase-keys")
    drop(held)
    phrases = materialize(phrase_counts(keys, width, least, per_range), "phrases")
    drop(keys)
    zero = F.lit(0).cast("long")
    counts = phrases.filter(F.col("size") < LONGEST).select(*IDS, "n").unionByName(dictionary.select(F.col("id").alias(IDS[0]), *[zero.alias(i) for i in IDS[1:]], "n"))
    side = lambda x: counts.select(*[F.col(i).alias(f"{x}{k}") for k, i in enumerate(IDS)], F.col("n").alias(x))
    k = F.col("k")
    cuts = phrases.select(*IDS, "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", *[c.alias(f"l{j}") for j, c in enumerate(_part(F.lit(0), k))], *[c.alias(f"r{j}") for j, c in enumerate(_part(k, F.col("size") - k))])
    cuts = cuts.join(side("l"), [f"l{j}" for j in range(LONGEST)]).join(side("r"), [f"r{j}" for j in range(LONGEST)])
    product = F.col("a").cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    score = F.call_function("div", product, (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    scored = cuts.groupBy(*IDS, "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("size") - m), lambda b: F.struct(b.alias("begin"), m.alias("length")))))
    inner = phrases.filter("size > 2").select(*IDS, "n", F.explode(places).alias("p"))
    inner = inner.select("n", *[c.alias(i) for i, c in zip(IDS, _part(F.col("p.begin"), F.col("p.length")), strict=True)])
    longer = inner.groupBy(*IDS).agg(F.max("n").alias("longer"))
    wide = lambda c, x: c.cast("decimal(19,0)") * F.lit(x)
    left = scored.join(longer, IDS, "left").filter(F.col("longer").isNull() | (wide(F.col("longer"), 100) < wide(F.col("a"), shared)))
    left = left.join(dictionary.select("lang", F.col("id").alias(IDS[0])), IDS[0])
    near = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    #: Ties stay together until the phrases themselves are known.
    best = materialize(left.withColumn("near", F.rank().over(near)).filter(F.col("near") <= top).select("lang", *IDS, "a", "cut"), "best-phrases")
    named = best.select(*IDS, F.posexplode(F.array(*IDS)).alias("at", "id")).filter("id > 0").join(dictionary.select("id", "word"), "id")
    named = named.groupBy(*IDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # four words at most
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.join(named, IDS).join(totals, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score"))
    ranked = out.withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, ws[i:i + m - 1] AS ws FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) t(m))
), f AS MATERIALIZED (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (
  SELECT lang, ws, f AS a, k FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM f)
), cut AS (
  SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, (({UNIT}::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:len(c.ws)]
), low AS MATERIALIZED (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (
  SELECT lang, sub, max(f) AS f FROM (
    SELECT lang, f, ws[b:b + m - 1] AS sub FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS b FROM f, range(2, {LONGEST}) t(m) WHERE m < len(ws))) GROUP BY ALL
), best AS (
  SELECT low.lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.sub = low.ws WHERE inside.f IS NULL OR 100 * inside.f < {SHARED} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
