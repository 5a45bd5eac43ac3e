"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should have; an already running session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; partitions sets spark.sql.shuffle.partitions."""
    b = SparkSession.builder.master(master).appName("lodestone").config(map=DEFAULTS | conf)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


#: Larger tables are not spread: their scans have partitions enough, and moving them would cost more than it brings.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than there are cores; a table of over SPREAD_BYTES stays as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(n)


#: Of a scan's partitions, how many a task takes at most, and the bytes from which it takes no more.
GATHERED, GATHERED_BYTES = 64, 128 << 20


def gathered(scan: DataFrame) -> DataFrame:
    """A scan of files in fewer tasks: Spark plans one for each 32 small files, however small they are."""
    parts, size = scan.rdd.getNumPartitions(), int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(4 * scan.sparkSession.sparkContext.defaultParallelism, parts // GATHERED, size // GATHERED_BYTES)
    return scan.coalesce(n) if n < parts else scan
