"""Writers."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..tables import stored

#: Columns of a comparison's CSV file, in order. Fixed values.
RESULT_COLUMNS = ["question_id", "question", "category", "important", "gold_notice_id", "method", "answer", "top1_notice_id", "retrieved_notice_ids", "source_titles", "source_urls", "posted_at", "retrieval_scores", "latency_ms", "refusal", "refusal_reason", "generation_provider", "generation_model", "base_generation_model", "important_generation_model", "model_version", "temperature", "max_output_tokens", "prompt_version", "run_date", "input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd"]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """JSON lines with sorted keys; characters beyond ASCII stay as they are."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """Part files with a header; values with line feeds and quotes can be read back with multiLine and escape '\"'."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    flat(df.select(*cols)).write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_csv_file(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file with a byte order mark, for spreadsheets. Rows pass through the driver one at a time; for reports, not for tables of any size."""
    import csv

    cols = columns or df.columns
    rows = flat(df.select(*[c for c in cols if c in df.columns]))
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(cols)
        for r in rows.toLocalIterator():
            d = r.asDict()
            w.writerow(["" if d.get(c) is None else d[c] for c in cols])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path), for any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_document(df: DataFrame, path: str) -> None:
    """The only row of df as a JSON file."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one row expected, found {'more' if rows else 'none'}")
    fs, p = _hadoop(df.sparkSession, path)
    out = fs.create(p, True)
    out.write((json.dumps(rows[0].asDict(True), ensure_ascii=False, indent=2, default=str) + "\n").encode())
    out.close()


def replace_index(df: DataFrame, path: str, keys: tuple[str, ...] = ("index_name", "index_version")) -> None:
    """Replaces the partitions that df has, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_log(df: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*keys) if keys else w).parquet(path)


def chat_log(answers: DataFrame) -> DataFrame:
    """Answers as log rows: labels of sources joined by ` | `, the time of writing added."""
    labels = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<struct<label:string,snippet:string,score:double,title:string,url:string,posted_at:string>>")), lambda s: s["label"]), " | ")
    return answers.select("query_id", F.col("status").alias("retrieval_status"), "answer", labels.alias("source_labels"), F.current_timestamp().alias("created_at"))


def write_jdbc(df: DataFrame, url: str, table: str, **properties: str) -> None:
    from .readers import jdbc_url

    whole, props = jdbc_url(url)
    df.write.jdbc(whole, table, mode="append", properties=props | properties)


def with_ids(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """df with `id`, numbered without gaps by order: numbers within range partitions plus the counts before.

    Places are stored before they are counted: partitions computed anew could have other borders.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], start
    for r in at.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        before.append((r["p"], total))
        total += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p int, _start long"))  # as many rows
    return at.withColumn("_p", part.cast("int")).join(starts, "_p").withColumn("id", F.col("_start") + nth).drop("_at", "_p", "_start")


def write_files(df: DataFrame, folder: str, name_col: str = "path", text_col: str = "document") -> None:
    """A text file for each row, below a folder that all tasks share."""
    root = Path(folder).resolve()

    def inside(p: Path) -> Path:
        if root not in (p := p.resolve()).parents:
            raise ValueError(f"{p} lies outside {root}")
        p.parent.mkdir(parents=True, exist_ok=True)
        return p

    def put(rows) -> None:
        known: dict[str, str] = {}  # folders, looked up once
        for name, text in rows:
            last = name.rpartition("/")[2]
            at = name.removesuffix(last)
            if at not in known:
                known[at] = str(inside(root / at / "_").parent)
            p = f"{known[at]}/{last}"
            if last in ("", ".", "..") or os.path.islink(p):
                p = inside(root / name)
            with open(p, "wb") as f:
                f.write(text.encode())

    df.select(name_col, text_col).foreachPartition(put)


def reset_folder(spark: SparkSession, folder: str, workspace: str) -> None:
    """Empties a folder; refuses one that isn't inside the workspace. `..` is resolved, links are not followed."""
    fs, target = _hadoop(spark, folder)
    inside, root = str(fs.makeQualified(target).toString()), str(fs.makeQualified(_hadoop(spark, workspace)[1]).toString())
    if not inside.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{folder} lies outside {workspace}")
    fs.delete(target, True)
    fs.mkdirs(target)
