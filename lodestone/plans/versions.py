"""An index that is kept up to date: versions made of segments, published all at once, by one writer at a time.

A version is a commit file that lists segments. A segment holds what one update added: documents with their digests,
chunks, counted texts, vectors, the differences in document frequencies and totals, and the documents of earlier
segments that it replaces or takes away. Segments are written aside and never changed; a version exists from the moment
its commit file is in place, so a reader has the old version or the new one, whatever fails on the way.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..defaults import Settings
from ..functions.vectors import sha256_parts, with_embedding
from ..operators import lexical
from ..operators.chunks import chunk_table
from ..tables import stored
from .search import Index

#: Segments of a version from which the next update builds all anew; so does one after which more documents are dead than alive.
SEGMENTS = 32
KEEP = ["title", "path", "url", "posted_at", "content_type", "metadata"]
TABLES = ["documents", "chunks", "texts", "vectors", "terms", "totals", "dead"]


class Refused(RuntimeError):
    """Another writer has the index."""


class Files:
    """Small files below a root, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one."""
        try:
            out = self.fs.create(self.path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        source = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def rename(self, old: str, new: str) -> bool:
        try:
            return self.fs.rename(self.path(old), self.path(new))
        except Py4JJavaError:  # the old one has gone
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []


class Lease:
    """The right to write, for one owner until a time; taken over when that time has passed.

    It is exclusive where the file system creates a file for one of several callers only, as shared ones do.
    """

    NAME = "lease.json"

    def __init__(self, files: Files, seconds: float = 3600, owner: str | None = None):
        self.files, self.seconds, self.owner = files, seconds, owner or uuid.uuid4().hex

    def held(self) -> dict | None:
        text = self.files.read(self.NAME)
        return None if text is None else json.loads(text or '{"owner": "", "until": 9e15}')  # an empty file is being written

    def _mine(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.seconds})

    def __enter__(self) -> Lease:
        for _ in range(3):
            if self.files.create(self.NAME, self._mine()):
                if (self.held() or {}).get("owner") == self.owner:
                    return self
                break
            held = self.held()
            if held is not None and held["until"] > time.time():
                break
            gone = f"lease-ended-{uuid.uuid4().hex}"  # one of several that find it ended moves it away
            if held is not None and self.files.rename(self.NAME, gone):
                self.files.delete(gone)
        raise Refused("another writer has the index")

    def valid(self) -> bool:
        held = self.held()
        return held is not None and held["owner"] == self.owner and held["until"] > time.time()

    def __exit__(self, *_) -> None:
        if (self.held() or {}).get("owner") == self.owner:
            self.files.delete(self.NAME)


@dataclass
class Version:
    number: int
    segments: list[str]
    documents: int
    dead: int
    made_by: str


class VersionedIndex:
    """The index of a corpus below a shared folder. documents: (document_id, title, path, url, posted_at, content_type, metadata, text), ids unique and not null."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, profile: str = "offline"):
        self.spark, self.root, self.settings, self.profile = spark, root.rstrip("/"), settings or Settings(), profile
        self.files = Files(spark, root)

    # -- versions

    def current(self) -> Version | None:
        done = [n for n in self.files.names("commits") if n.endswith(".json")]
        return Version(**json.loads(self.files.read(f"commits/{done[-1]}"))) if done else None

    def publish(self, v: Version) -> None:
        """Puts the commit file in place; a number is given once."""
        name = f"commits/{v.number:010}"
        if not self.files.create(f"{name}.claim", ""):
            raise Refused(f"version {v.number} is taken")
        self.files.create(f"{name}.tmp", json.dumps(vars(v)))
        self.files.rename(f"{name}.tmp", f"{name}.json")

    def clean(self) -> None:
        """Deletes segments that no version lists, and claims of versions that never came. For the one who has the lease."""
        known = [n for n in self.files.names("commits") if n.endswith(".json")]
        used = {s for n in known for s in json.loads(self.files.read(f"commits/{n}"))["segments"]}
        for s in set(self.files.names("segments")) - used:
            self.files.delete(f"segments/{s}")
        for n in self.files.names("commits"):
            if not n.endswith(".json") and n.split(".")[0] + ".json" not in known:
                self.files.delete(f"commits/{n}")

    # -- reading

    def _table(self, v: Version, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/segments/{s}/{name}") for s in v.segments])

    def _live(self, v: Version, name: str, key: str = "document_id") -> DataFrame:
        """Rows of documents that no later segment replaces."""
        rows = self._table(v, name)
        return rows if not v.dead else rows.join(self._table(v, "dead").select(F.col("segment"), F.col("document_id").alias(key)), ["segment", key], "left_anti")

    def read(self, v: Version | None = None) -> Index:
        """The version's index, as search.hybrid() and its like take it."""
        v = v or self.current()
        texts = self._live(v, "texts", "document").drop("segment")
        terms = self._table(v, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        total = self._table(v, "totals").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "total_tokens", "documents")])
        stats = total.select("n", "total_tokens", F.when(F.col("n") > 0, F.col("total_tokens") / F.col("n")).otherwise(0.0).alias("avgdl"), "documents")
        vectors = self._live(v, "vectors").select("id", "embedding")
        return Index(self._live(v, "chunks").drop("segment"), lexical.Bm25Index(texts, terms, stats, self.profile), vectors, self.profile, self.settings.embedding_dim)

    def digests(self, v: Version) -> DataFrame:
        """(document_id, digest, segment)"""
        return self._live(v, "documents")

    # -- writing

    def _digested(self, documents: DataFrame) -> DataFrame:
        plain = [F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in [*KEEP[:-1], "text"]]
        meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("\2"), F.coalesce(e["value"], F.lit("\1"))))
        return documents.withColumn("digest", sha256_parts(F.concat(F.array(*plain), F.coalesce(meta, F.array().cast("array<string>")))))

    def _write(self, name: str, segment: str, table: DataFrame) -> DataFrame:
        path = f"{self.root}/segments/{segment}/{name}"
        table.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def _totals(self, texts: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
        """(term, df) and (n, total_tokens, documents) of counted texts, with a sign."""
        df = texts.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))
        t = lexical.totals(texts)
        return df, t.select(*[(F.col(c) * sign).cast("long").alias(c) for c in ("n", "total_tokens", "documents")])

    def _add(self, segment: str, added: DataFrame, gone: DataFrame, old: Version | None, broken: Callable[[str], None] | None) -> None:
        """Writes a segment: added documents (with digest), and gone (document_id, segment), which it takes away."""
        step = broken or (lambda _: None)
        s, own = self.settings, F.lit(segment).alias("segment")
        self._write("documents", segment, added.select("document_id", "digest", own))
        first = F.col("title") if self.profile == "online" else "Document"
        c = chunk_table(added, "document_id", "text", s.chunk_size, first_name=first, keep=KEEP).withColumn("id", F.col("chunk_id")).withColumn("page", F.lit(None).cast("int"))
        chunks = self._write("chunks", segment, c.select("*", own))
        step("chunks")
        texts = self._write("texts", segment, lexical.counted(chunks, "id", "text", self.profile, "document_id").select("*", own))
        self._write("vectors", segment, with_embedding(chunks.select("id", "document_id", "text"), "text", self.profile, s.embedding_dim).select("id", "document_id", "embedding", own))
        dead = self._write("dead", segment, gone.select("segment", "document_id"))
        terms, totals = self._totals(texts, 1)
        if old is not None and not dead.isEmpty():
            #: Only what is taken away is read of the earlier segments' texts.
            lost = self._live(old, "texts", "document").join(dead.select("segment", F.col("document_id").alias("document")), ["segment", "document"], "left_semi")
            less, fewer = self._totals(lost, -1)
            terms, totals = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), totals.unionByName(fewer)
        self._write("terms", segment, terms)
        self._write("totals", segment, totals)

    def update(self, documents: DataFrame, force: bool = False, seconds: float = 3600, broken: Callable[[str], None] | None = None) -> dict:
        """Brings the index to these documents: a dict of reason, version, added, changed, deleted, same.

        Only documents whose digest is new are cut, counted and embedded; of those that changed or went, only their
        places are noted. Raises Refused while another writer has the index. broken: called between steps, for tests.
        """
        with Lease(self.files, seconds) as lease:
            old = None if force else self.current()
            now = self._digested(documents)
            if old is None:
                kinds = now.agg(F.count("*").alias("added")).first()  # one row
                counts, reason = {"added": kinds["added"], "changed": 0, "deleted": 0, "same": 0}, "FORCED" if force else "FIRST"
                added, gone = now, self.spark.createDataFrame([], "segment string, document_id string").withColumn("document_id", F.col("document_id").cast(documents.schema["document_id"].dataType))
            else:
                had = self.digests(old).select("document_id", F.col("digest").alias("had"), "segment")
                kind = F.when(F.col("had").isNull(), "added").when(F.col("digest").isNull(), "deleted").when(F.col("had") != F.col("digest"), "changed").otherwise("same")
                told = stored(now.select("document_id", "digest").join(had, "document_id", "full").select("document_id", "segment", kind.alias("kind")), "changes")
                counts = {k: 0 for k in ("added", "changed", "deleted", "same")} | {r["kind"]: r["count"] for r in told.groupBy("kind").count().collect()}
                if counts["same"] == told.count():
                    return {"reason": "UP_TO_DATE", "version": old.number, **counts}
                dead = old.dead + counts["changed"] + counts["deleted"]
                if len(old.segments) >= SEGMENTS or dead > documents.count():
                    reason, added, gone = "COMPACTED", now, told.filter("false").select("segment", "document_id")
                else:
                    reason = "CHANGED"
                    added = now.join(told.filter("kind in ('added', 'changed')").select("document_id"), "document_id", "left_semi")
                    gone = told.filter("kind in ('changed', 'deleted')").select("segment", "document_id")
            whole = reason != "CHANGED"
            segment = uuid.uuid4().hex
            self._add(segment, added, gone, None if whole else old, broken)
            newest = self.current()
            number = newest.number + 1 if newest else 1
            if not lease.valid():
                raise Refused("the lease has ended")
            live = counts["added"] + counts["changed"] + counts["same"]
            self.publish(Version(number, [segment] if whole else [*old.segments, segment], live, 0 if whole else old.dead + counts["changed"] + counts["deleted"], reason))
            return {"reason": reason, "version": number, **counts}
