"""One index under one folder, with the calls that a service would expose."""

from __future__ import annotations

import hmac
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .defaults import Settings, clamp_limits
from .operators import admission, lexical, provenance
from .operators.generation import Provider, generate
from .plans import search
from .sources.readers import valid_questions


class Refused(PermissionError):
    """A call without the right key, or too soon after the last."""


class Engine:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, profile: str = "online", admin_key: str = "", cooldown_seconds: int = 300, clock=time.time):
        self.spark, self.path, self.settings, self.profile = spark, path.rstrip("/"), settings or Settings(), profile
        self._key, self._cooldown, self._clock, self._last = admin_key, cooldown_seconds, clock, None

    def _index(self) -> search.Index:
        s = self.settings
        return search.Index.read(self.spark, f"{self.path}/{s.index_name}/{s.index_version}", self.profile, s.embedding_dim)

    def check_key(self, key: str | None) -> None:
        if not self._key or not hmac.compare_digest((key or "").encode(), self._key.encode()):
            raise Refused("wrong key")

    def reindex(self, documents: DataFrame, key: str | None = None, force: bool = False) -> str:
        """The reason why the index was built, or INDEX_UP_TO_DATE."""
        self.check_key(key)
        now = self._clock()
        if self._last is not None and now - self._last < self._cooldown:
            raise Refused(f"wait {self._cooldown - (now - self._last):.0f} s")
        self._last = now
        return search.reindex(documents, self.path, self.settings, force, self.profile)[0]

    def status(self) -> DataFrame:
        ix = self._index()
        meta = self.spark.read.parquet(f"{self.path}/index_metadata")
        return provenance.index_status(meta, {"chunks": ix.chunks, "embeddings": ix.vectors, "terms": ix.bm25.terms}, self.settings.index_name, self.settings.index_version)

    def bm25_search(self, questions: DataFrame, limit: int = 5) -> DataFrame:
        ix = self._index()
        return search.with_chunks(lexical.search(ix.bm25, questions, clamp_limits("bm25", limit=limit)["limit"]), ix)

    def dense_search(self, questions: DataFrame, limit: int = 5) -> DataFrame:
        ix = self._index()
        return search.with_chunks(search.dense_only(ix, questions, clamp_limits("dense", limit=limit)["limit"]), ix)

    def hybrid_search(self, questions: DataFrame, top_k: int = 5, bm25_top_k: int = 50, dense_top_k: int = 50, rrf_k: int = 60, log: str | None = None) -> DataFrame:
        lim = clamp_limits("hybrid", top_k=top_k, bm25_top_k=bm25_top_k, dense_top_k=dense_top_k, rrf_k=rrf_k)
        s = search.with_settings(self.settings, hybrid_top_k=lim["top_k"], bm25_top_k=lim["bm25_top_k"], dense_top_k=lim["dense_top_k"], rrf_k=lim["rrf_k"])
        ix = self._index()
        ranked = search.hybrid(ix, questions, s)
        if log:
            from .sources.sinks import append_log

            append_log(search.retrieval_log(ranked, questions, ix, s), log)
        return search.with_chunks(ranked, ix)

    def chat(self, requests: DataFrame, provider: Provider | None = None, log: str | None = None) -> DataFrame:
        """(query_id, status, answer, sources) of requests (query_id, question, ts, ip, session_id): validated, admitted, answered.

        INVALID and RATE_LIMITED requests have no answer.
        """
        ok, bad = valid_questions(requests)
        told = admission.decide(ok.withColumnRenamed("query_id", "request_id"), self.settings).select(F.col("request_id").alias("query_id"), "admitted")
        known = ok.join(told, "query_id")
        make = (lambda rows: generate(rows, provider, self.settings).select("query_id", "answer")) if provider else None
        answers = search.chat(self._index(), known.filter("admitted").select("query_id", "question"), self.settings, make).drop("prompt")
        if log:
            from .sources.sinks import append_log, chat_log

            append_log(chat_log(answers), log)
        none = lambda df, status: df.select("query_id", F.lit(status).alias("status"))
        out = answers.unionByName(none(known.filter("not admitted"), "RATE_LIMITED"), allowMissingColumns=True)
        return out.unionByName(none(bad, "INVALID"), allowMissingColumns=True)
