"""BM25 by posting lists in blocks with bounds: the exact top k of each question from part of the blocks.

A term's postings are cut, in falling order of impact (what the term adds to a score, for a weight of 1), into blocks
of BLOCK postings that carry their largest impact. A task makes the blocks of its own texts; only what doesn't fill a
block meets what others left over, in groups of MERGED slabs. So no task holds a frequent term's list.

A question's terms are taken from the largest possible contribution down. A text is found at the latest by the first
term, in this order, that it has: it can add what its block's bound allows there and what later terms add at most. With
a score that k texts are known to reach, blocks that allow less are skipped. Texts found are kept if what they have
shown, and the bounds of what was skipped, may reach that score; those few are scored from their own terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..defaults import BM25_B, BM25_K1
from ..functions.numbers import round_half_up
from ..tables import dropped, stored
from . import lexical

#: Postings of a block; postings that a task sorts at once; slabs whose leftovers meet.
BLOCK, SLAB, MERGED = 128, 2_000_000, 1024
POSTS = "array<struct<number:long,tf:int,dl:int>>"
#: Blocks are stored by bands of this width below the largest impact there is.
BAND = 0.25
#: Texts of a question, times k, that are scored to learn which score k texts reach; postings of the weightiest terms that show which texts these are.
SEEDS, SEED_POSTINGS = 4, 20_000
#: Scores are equal within this.
EPSILON = 1e-6


@dataclass
class PostingIndex:
    """texts (number, id, document, dl, terms, tfs); blocks (band, block, term, n, bound, posts); bm25: its terms and totals."""

    texts: DataFrame
    blocks: DataFrame
    bm25: lexical.Bm25Index
    k1: float
    b: float

    @property
    def heads(self) -> DataFrame:
        """(term, band, block, n, bound): what tells whether a block is read."""
        return self.blocks.select("term", "band", "block", "n", "bound")


def impact(tf: Column, dl: Column, avgdl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What a term adds to a score for a weight of 1: below k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def slab_blocks(texts: DataFrame, avgdl: float, k1: float, b: float, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(term, slab, n, bound, posts): each slab's postings, by term and falling impact, in blocks; the last of a term may be short."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush(held: list, at: int):
            term = pa.chunked_array([x.column(2).flatten() for x in held]).combine_chunks().dictionary_encode()
            code = term.indices.to_numpy().astype(np.int64)
            if not len(code):
                return
            long = np.concatenate([x.column(2).value_lengths().to_numpy() for x in held])
            number, dl = (np.repeat(np.concatenate([x.column(c).to_numpy() for x in held]), long) for c in (0, 1))
            tf = np.concatenate([x.column(3).flatten().to_numpy() for x in held])
            worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            order = np.lexsort((number, -worth, code))
            code, number, dl, tf, worth = (x[order] for x in (code, number, dl, tf, worth))
            first = np.flatnonzero(np.diff(code, prepend=-1))
            place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
            begin = np.flatnonzero(place % block == 0)
            posts = pa.StructArray.from_arrays([pa.array(number), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int32))], ["number", "tf", "dl"])
            edges = np.append(begin, len(code))
            for k in range(0, len(begin), 20_000):
                own = edges[k : k + 20_001]
                part = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), posts.slice(own[0], own[-1] - own[0]))
                columns = [term.dictionary.take(pa.array(code[own[:-1]])), pa.array(np.full(len(own) - 1, at)), pa.array(np.diff(own)), pa.array(worth[own[:-1]]), part]
                yield pa.RecordBatch.from_arrays(columns, ["term", "slab", "n", "bound", "posts"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= slab:
                yield from flush(held, at)
                held, size, at = [], 0, at + 1
        if held:
            yield from flush(held, at)

    return texts.select("number", "dl", "terms", "tfs").mapInArrow(run, f"term string, slab long, n long, bound double, posts {POSTS}")


def merged(short: DataFrame, avgdl: float, k1: float, b: float, block: int = BLOCK, slabs: int = MERGED) -> DataFrame:
    """(term, n, bound, posts): short blocks of a term, as many slabs' together as stated, cut anew by falling impact."""
    group = short.groupBy("term", F.call_function("div", F.col("slab"), F.lit(slabs)).alias("g"))
    whole = group.agg(F.flatten(F.collect_list("posts")).alias("posts"))  # under BLOCK postings for each of so many slabs
    worth = F.transform("posts", lambda p: F.struct(impact(p["tf"], p["dl"], F.lit(avgdl), k1, b).alias("impact"), p.alias("post")))
    pieces = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("sorted") - 1, F.lit(block))), lambda k: F.slice("sorted", (k * block + 1).cast("int"), F.lit(block)))
    cut = whole.select("term", F.sort_array(worth, asc=False).alias("sorted")).select("term", F.explode(pieces).alias("own"))
    return cut.select("term", F.size("own").cast("long").alias("n"), F.col("own")[0]["impact"].alias("bound"), F.transform("own", lambda x: x["post"]).alias("posts"))


def build(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", profile: str = "offline", document_col: str | None = None, k1: float = BM25_K1, b: float = BM25_B, block: int = BLOCK, slab: int = SLAB) -> PostingIndex:
    """The index of df's texts. Null and empty texts count in the totals and have no postings; an empty table has no blocks."""
    texts = stored(lexical.counted(df, id_col, text_col, profile, document_col).withColumn("number", F.monotonically_increasing_id()), "posting-texts", compression="zstd")
    bm25 = lexical.Bm25Index.of(texts, profile)
    avgdl = bm25.stats.first()["avgdl"] or 1.0  # one row
    banded = lambda t: t.withColumn("band", F.floor((k1 + 1 - F.col("bound")) / BAND).cast("int")).withColumn("block", F.monotonically_increasing_id())
    made = stored(banded(slab_blocks(texts, avgdl, k1, b, block, slab)).withColumn("short", F.col("n") < block), "slab-blocks", ("short", "band"), compression="zstd")
    rest = stored(banded(merged(made.filter("short"), avgdl, k1, b, block)), "merged-blocks", ("band",), compression="zstd")
    own = ["band", "term", "n", "bound", "posts"]
    blocks = made.filter("not short").select((F.col("block") * 2).alias("block"), *own).unionByName(rest.select((F.col("block") * 2 + 1).alias("block"), *own))
    return PostingIndex(texts, blocks, bm25, k1, b)


def exact(index: PostingIndex, found: DataFrame, asked: DataFrame, few: list | None) -> DataFrame:
    """(query_id, id, score) of (query_id, number), from the texts' own terms; few: asked's rows, if they are few.

    Each text is read once for all questions that it may answer.
    """
    if few is None:
        own = found.join(index.texts.select("number", "id", "dl", "terms", "tfs"), "number")
        own = own.select("query_id", "id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("query_id", "id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        part = F.col("w") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b)
        return own.join(asked, ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    own = found.groupBy("number").agg(F.collect_list("query_id").alias("asked")).join(index.texts.select("number", "id", "dl", "terms", "tfs"), "number")  # as many as are sent
    kinds = [found.schema["query_id"].dataType, index.texts.schema["id"].dataType]
    q_arrow, id_arrow = (to_arrow_type(t) for t in kinds)
    terms = {t: n for n, t in enumerate(sorted({r["term"] for r in few}))}
    by: dict = {}
    for r in few:
        by.setdefault(r["query_id"], ([], []))[0].append(terms[r["term"]])
        by[r["query_id"]][1].append(r["w"])
    k1, b = index.k1, index.b
    sent = found.sparkSession.sparkContext.broadcast((list(terms), list(by), [(np.array(t), np.array(w)) for t, w in by.values()], few[0]["avgdl"] if few else 1.0))

    def run(batches):
        known, names, queries, avgdl = sent.value
        known, names = pa.array(known, pa.string()), pa.array(names, q_arrow)
        step = max(64, min(4096, lexical.CELLS // max(1, len(known))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = batch.column(3)
                number = pc.index_in(own.flatten(), value_set=known)
                ok = number.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy())[ok]
                tf, dl = batch.column(4).flatten().to_numpy()[ok].astype(np.float64), batch.column(2).to_numpy()[row]
                worth = np.zeros((batch.num_rows, len(known)))
                worth[row, number.drop_null().to_numpy()] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                lists = batch.column(0)
                q = pc.index_in(lists.flatten(), value_set=names).to_numpy()
                text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                order = np.argsort(q, kind="stable")
                q, text, score = q[order], text[order], np.zeros(len(q))
                edge = np.searchsorted(q, np.arange(len(queries) + 1))
                for k in np.unique(q).tolist():
                    own_terms, w = queries[k]
                    score[edge[k] : edge[k + 1]] = worth[np.ix_(text[edge[k] : edge[k + 1]], own_terms)] @ w
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(1).take(pa.array(text)).cast(id_arrow), pa.array(score)], ["query_id", "id", "score"])

    return own.select("asked", "id", "dl", "terms", "tfs").mapInArrow(run, f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double")


def ordered_terms(index: PostingIndex, asked: DataFrame) -> DataFrame:
    """asked (query_id, term, w, avgdl) with n (its postings), most (what it adds at most), rest (what the terms behind it in falling order of `most` add at most)."""
    top = index.heads.groupBy("term").agg(F.max("bound").alias("top"), F.sum("n").alias("n"))
    behind = Window.partitionBy("query_id").orderBy(F.desc("most"), "term").rowsBetween(1, Window.unboundedFollowing)  # a question's terms
    known = asked.join(top, "term").withColumn("most", F.col("w") * F.col("top"))
    return known.withColumn("rest", F.coalesce(F.sum("most").over(behind), F.lit(0.0)))


def shown(index: PostingIndex, picked: DataFrame) -> DataFrame:
    """(query_id, number, term, gain, left) of picked (query_id, term, block, band, w, left)'s postings; only the bands asked for are read."""
    bands = [r["band"] for r in picked.select("band").distinct().collect()]  # (k1 + 1) / BAND at most
    rows = index.blocks.filter(F.col("band").isin(bands or [-1])).select("block", "posts").join(picked, "block").crossJoin(F.broadcast(index.bm25.stats.select(F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))))  # one row
    rows = rows.select("query_id", "term", "w", "left", "avgdl", F.explode("posts").alias("p"))
    return rows.select("query_id", "term", F.col("p.number").alias("number"), (F.col("w") * impact(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"), index.k1, index.b)).alias("gain"), "left")


def reached(index: PostingIndex, partly: DataFrame, asked: DataFrame, few: list | None, k: int) -> DataFrame:
    """(query_id, floor): a score that k texts of a question reach, by scoring the best of partly (query_id, number, gain); no row where fewer are known."""
    by = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c))
    best = partly.withColumn("r", F.row_number().over(by("gain"))).filter(F.col("r") <= SEEDS * k).select("query_id", "number")
    ranked = exact(index, best, asked, few).withColumn("r", F.row_number().over(by("score"))).filter(F.col("r") <= k)
    return ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).select("query_id", (F.col("floor") - EPSILON).alias("floor"))


def seeds(index: PostingIndex, terms: DataFrame) -> DataFrame:
    """(query_id, number, gain): what a question's weightiest terms give, those with SEED_POSTINGS together and the one behind them."""
    upto = Window.partitionBy("query_id").orderBy(F.desc("w"), "term").rowsBetween(Window.unboundedPreceding, -1)
    first = terms.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter(F.col("before") < SEED_POSTINGS).select("query_id", "term", "w", F.lit(0.0).alias("left"))
    picked = first.join(index.heads.select("term", "block", "band"), "term")
    return shown(index, picked).groupBy("query_id", "number").agg(F.sum("gain").alias("gain"))


def blocks_to_read(index: PostingIndex, terms: DataFrame, floors: DataFrame) -> DataFrame:
    """Each block of each question's terms: (query_id, term, w, block, band, n, bound, read)."""
    own = terms.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    heads = own.select("query_id", "term", "w", "rest", "floor").join(index.heads, "term")
    return heads.withColumn("read", F.col("w") * F.col("bound") + F.col("rest") >= F.col("floor"))


def search(index: PostingIndex, queries: DataFrame, k: int = 50, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, id, bm25_score, bm25_rank): as lexical.search(), whatever is skipped.

    Questions without known terms have no rows. Ties are ranked by id. Online scores are rounded to 6 places after
    ranking.
    """
    scored = candidates(index, queries, k, id_col, text_col)[0]
    out = lexical.top_k(scored, k, rank="bm25_rank")
    score = round_half_up(F.col("score"), 6) if index.bm25.profile == "online" else F.col("score")
    return out.select("query_id", "id", score.alias("bm25_score"), "bm25_rank")


def candidates(index: PostingIndex, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "question") -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score) of all texts that may be among the k best, blocks_to_read() as a stored table)."""
    asked = stored(lexical.weighted(index.bm25, queries, id_col, text_col), "asked")
    few = asked.limit(lexical.SENT_TERMS + 1).collect()  # questions' terms are sent to the tasks if they are few
    few = few if len(few) <= lexical.SENT_TERMS else None
    terms = stored(ordered_terms(index, asked), "asked-terms")
    floors = stored(reached(index, seeds(index, terms), asked, few, k), "floors")
    heads = stored(blocks_to_read(index, terms, floors), "heads")
    #: What a term may still add, for texts that its read blocks don't have.
    left = heads.groupBy("query_id", "term").agg(F.coalesce(F.max(F.when(~F.col("read"), F.col("w") * F.col("bound"))), F.lit(0.0)).alias("left"))
    picked = heads.filter("read").select("query_id", "term", "w", "block", "band").join(left, ["query_id", "term"])
    seen = shown(index, picked).groupBy("query_id", "number").agg(F.sum("gain").alias("gain"), F.sum("left").alias("left"))
    rest = left.groupBy("query_id").agg(F.sum("left").alias("all")).join(floors, "query_id", "left")
    reach = lambda t, floor: t.filter(F.col("gain") + F.col("all") - F.col("left") >= F.coalesce(floor, F.lit(0.0)) - EPSILON)
    seen = stored(reach(seen.join(rest, "query_id"), F.col("floor")), "seen")
    now = reached(index, seen, asked, few, k).withColumnRenamed("floor", "higher")  # more is known of the best by now
    found = stored(reach(seen.join(now, "query_id", "left"), F.greatest("floor", "higher")).select("query_id", "number"), "candidates")
    dropped(terms, floors, seen)
    return exact(index, found, asked, few), heads
