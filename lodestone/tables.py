"""Tables that cut lineage: written once to the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if context.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def stored(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """df, computed once: what is read back starts from files, so a lost executor repeats nothing before them.

    by: columns that the files are dealt by, so that a filter on them reads those files only. options: of the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*by) if by else df.write
    w.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path  # type: ignore[attr-defined]
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_lodestone_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_turn(blocks: Iterable, search: Callable[[Any], tuple[DataFrame, Any]], name: str) -> DataFrame | None:
    """What search(block) finds (a table, and the broadcast it reads) for all blocks, one below the other; None without blocks.

    A single block's result is left to be computed. Of several, each is stored and its broadcast destroyed before the
    next is taken, so the driver and the tasks hold one block at a time.
    """
    blocks = iter(blocks)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return None
    if second is None:
        return search(first)[0]
    found = []
    for block in chain([first, second], blocks):
        df, sent = search(block)
        found.append(stored(df, name))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)
