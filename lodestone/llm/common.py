"""What the operators share: tables in the cluster's shared folder, and reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(t) if name == "documents" else t


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Inside, the session has this setting; it gets back its own at the end."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops a query's shuffle files when that query ends, so that the disk holds one query's at a time."""
    with setting(spark, CLEANUP, "true"):
        yield


def handed_over(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Inside, a query that runs hands rows to Python in batches of about size bytes; Spark's own are of up to 64 MB, in the JVM and in Python."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and a lost executor costs nothing written before.

    options: of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path  # type: ignore[attr-defined]
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize() wrote and that no result reads any more."""
    for df in tables:
        if path := getattr(df, "_lodestone_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
