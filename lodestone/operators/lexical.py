"""BM25 over texts whose terms are counted once and stored.

The index is cut by texts: a text's counted terms are one row. So a task scores its texts by itself, for many questions
at once, and passes on the best of each question; no posting is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..defaults import BM25_B, BM25_K1
from ..functions.numbers import round_half_up
from ..functions.tokenizers import tokenizer
from ..tables import stored

#: Terms of queries, over all queries, that are sent to every task at most.
SENT_TERMS = 200_000
#: Texts whose tokens a task counts at once.
ROWS = 1024
#: Numbers in a task's table of terms by texts.
CELLS = 4 << 20


@dataclass
class Bm25Index:
    """texts (id, document, dl, terms, tfs): a row for each text; terms (term, df); stats (n, total_tokens, avgdl, documents): one row."""

    texts: DataFrame
    terms: DataFrame
    stats: DataFrame
    profile: str

    @classmethod
    def of(cls, texts: DataFrame, profile: str) -> Bm25Index:
        return cls(texts, texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), totals(texts), profile)

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf, dl)"""
        return posted(self.texts)

    def write(self, path: str) -> None:
        for name in ("texts", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str, profile: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("texts", "terms", "stats")), profile)


def counted(df: DataFrame, id_col: str, text_col: str, profile: str = "offline", document_col: str | None = None) -> DataFrame:
    """(id, document, dl, terms, tfs), a row for each text and without a shuffle: a text's tokens are counted where it is read."""
    t = df.select(F.col(id_col).alias("id"), F.col(document_col or id_col).alias("document"), tokenizer(profile)(F.col(text_col)).alias("tokens"))
    types = {c: t.schema[c].dataType for c in ("id", "document")}

    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            lists = batch.column(2)
            n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            size = max(1, len(flat.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + flat.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(key, size)
            edge = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
            own = [batch.column(k).cast(to_arrow_type(t)) for k, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.ListArray.from_arrays(edge, flat.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int64)))], ["id", "document", "dl", "terms", "tfs"])

    return t.mapInArrow(run, f"id {types['id'].simpleString()}, document {types['document'].simpleString()}, dl long, terms array<string>, tfs array<long>")


def posted(texts: DataFrame) -> DataFrame:
    return texts.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "dl")


def totals(texts: DataFrame) -> DataFrame:
    return texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.countDistinct("document").alias("documents"))


def term_frequency(df: DataFrame, id_col: str, text_col: str, profile: str = "offline") -> DataFrame:
    """(id, term, tf, dl)"""
    return posted(counted(df, id_col, text_col, profile))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, id_col: str, text_col: str, profile: str = "offline", document_col: str | None = None) -> DataFrame:
    """(n, total_tokens, avgdl, documents): texts without tokens count in n; avgdl is 0 for none."""
    t = df.select(F.size(tokenizer(profile)(F.col(text_col))).alias("dl"), F.col(document_col or id_col).alias("document"))
    return totals(t)


def build_index(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", profile: str = "offline", document_col: str | None = None) -> Bm25Index:
    """The one pass that reads the texts and cuts them into tokens; terms and totals come from what it stored."""
    return Bm25Index.of(stored(counted(df, id_col, text_col, profile, document_col), "bm25-texts"), profile)


def query_terms(queries: DataFrame, profile: str, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, term, weight): the online profile scores each term once, the offline one as often as it occurs."""
    t = queries.select(F.col(id_col).alias("query_id"), F.explode(tokenizer(profile)(F.col(text_col))).alias("term"))
    counted = t.groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    return counted if profile == "offline" else counted.withColumn("weight", F.lit(1).cast("long"))


def weighted(index: Bm25Index, queries: DataFrame, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, term, w, avgdl) of the queries' terms that the index has."""
    q = query_terms(queries, index.profile, id_col, text_col)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = q.join(index.terms, "term").crossJoin(F.broadcast(index.stats))  # stats is one row
    return asked.select("query_id", "term", (F.col("weight") * idf).alias("w"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))


def scores(index: Bm25Index, asked: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, id, score) of every pair that shares a term, by a join of postings; all such scores are above zero."""
    part = F.col("w") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return index.postings.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def best(index: Bm25Index, asked: list, k: int, query_type, k1: float = BM25_K1, b: float = BM25_B, places: int = 9) -> DataFrame:
    """As scores(), for terms that are sent to every task: of each task the texts that may be among the k best of a query."""
    spark = index.texts.sparkSession
    terms = {t: n for n, t in enumerate(sorted({r["term"] for r in asked}))}
    by: dict = {}
    for r in sorted(asked, key=lambda r: r["term"]):  # sums don't hang on the order in which a join gave the terms
        by.setdefault(r["query_id"], ([], []))[0].append(terms[r["term"]])
        by[r["query_id"]][1].append(r["w"])
    sent = spark.sparkContext.broadcast((list(terms), [(q, np.array(t), np.array(w)) for q, (t, w) in by.items()], asked[0]["avgdl"]))
    id_type = index.texts.schema["id"].dataType
    q_arrow, id_arrow = to_arrow_type(query_type), to_arrow_type(id_type)

    def run(batches):
        known, queries, avgdl = sent.value
        known = pa.array(known, pa.string())
        step = max(64, min(4096, CELLS // max(1, len(known))))
        ids: list[list] = [[] for _ in queries]
        got: list[list[np.ndarray]] = [[] for _ in queries]
        size, floor = np.zeros(len(queries), np.int64), np.full(len(queries), -np.inf)

        def cut(q: int) -> None:
            s = np.concatenate(got[q])
            r = np.round(s, places)
            floor[q] = -np.partition(-r, k - 1)[k - 1] if len(r) >= k else -np.inf
            keep = r >= floor[q]
            got[q], ids[q], size[q] = [s[keep]], [x for x, y in zip(ids[q], keep.tolist(), strict=True) if y], int(keep.sum())

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n, own, tfs = batch.num_rows, batch.column(2), batch.column(3)
                number = pc.index_in(own.flatten(), value_set=known)
                ok = number.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), own.value_lengths().to_numpy())[ok]
                tf = tfs.flatten().to_numpy()[ok].astype(np.float64)
                dl = batch.column(1).to_numpy()[row]
                impact = np.zeros((len(known), n))
                impact[number.drop_null().to_numpy(), row] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                names = batch.column(0).to_pylist()
                for q, (_, t, w) in enumerate(queries):
                    s = w @ impact[t]
                    pick = np.flatnonzero((s > 0) & (np.round(s, places) >= floor[q]))
                    if len(pick):
                        got[q].append(s[pick])
                        ids[q] += [names[x] for x in pick.tolist()]
                        size[q] += len(pick)
                        if size[q] > 4 * k:
                            cut(q)
        for q, (name, _, _) in enumerate(queries):
            if size[q]:
                cut(q)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids[q]), q_arrow), pa.array(ids[q], id_arrow), pa.array(got[q][0])], ["query_id", "id", "score"])

    return index.texts.select("id", "dl", "terms", "tfs").mapInArrow(run, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double")


def top_k(scored: DataFrame, k: int, by: str = "score", order: list | None = None, rank: str = "rank", places: int = 9) -> DataFrame:
    """The k best of each query. Scores are compared at so many places: sums differ in their last bits with the order of rows."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, places)), *(order or ["id"]))
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def search(index: Bm25Index, queries: DataFrame, k: int = 50, id_col: str = "query_id", text_col: str = "question", order: list | None = None) -> DataFrame:
    """(query_id, id, bm25_score, bm25_rank). Online scores are rounded to 6 places after ranking."""
    asked = weighted(index, queries, id_col, text_col)
    few = asked.limit(SENT_TERMS + 1).collect()  # questions' terms are sent to the tasks if they are few
    if few:
        scored = best(index, few, k, asked.schema["query_id"].dataType) if len(few) <= SENT_TERMS else scores(index, asked)
    else:
        scored = scores(index, asked.limit(0))
    out = top_k(scored, k, order=order, rank="bm25_rank")
    score = round_half_up(F.col("score"), 6) if index.profile == "online" else F.col("score")
    return out.select("query_id", "id", score.alias("bm25_score"), "bm25_rank")
