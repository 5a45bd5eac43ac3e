"""Tables of an SQLite database, one file in a folder that all processes share: each task has its own connection."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

#: Types that come back as they went; the database has no others.
KINDS = (LongType, IntegerType, DoubleType, BooleanType, StringType, BinaryType)
#: Rows that a connection reads at most, and those that it hands on at once; seconds that a task waits for others' writing.
ROWS, BATCH, WAIT_S = 1 << 18, 1 << 14, 3600


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(path, timeout=WAIT_S, isolation_level=None))


def _known(schema: StructType) -> None:
    if bad := [f"{f.name} {f.dataType.simpleString()}" for f in schema if not isinstance(f.dataType, KINDS)]:
        raise ValueError(f"types that the database doesn't have: {', '.join(bad)}")


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Adds df's rows to a table, which is made if it isn't there.

    A task puts its rows aside and adds them in one transaction, which notes that it has: tasks wait for each other
    while they add, and one that is run again adds nothing twice.
    """
    _known(df.schema)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    names, marks, job = ", ".join(map(_quoted, df.columns)), ", ".join("?" for _ in df.columns), uuid.uuid4().hex
    with _opened(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({names})")  # without types: values stay what they are
        db.execute("CREATE TABLE IF NOT EXISTS _added (job, part, PRIMARY KEY (job, part))")

    def put(rows) -> None:
        with _opened(path) as db:
            db.execute(f"CREATE TEMP TABLE aside ({names})")
            db.execute("BEGIN")
            db.executemany(f"INSERT INTO temp.aside VALUES ({marks})", (["NaN" if x != x else x for x in r] for r in rows))  # a NaN would become null
            db.execute("COMMIT")
            db.execute("BEGIN IMMEDIATE")
            if db.execute("INSERT OR IGNORE INTO main._added VALUES (?, ?)", (job, TaskContext.get().partitionId())).rowcount:
                db.execute(f"INSERT INTO main.{_quoted(table)} ({names}) SELECT * FROM temp.aside")
            db.execute("COMMIT")

    df.foreachPartition(put)


def sqlite_scan(spark: SparkSession, path: str, table: str, schema: StructType, connections: int = 1) -> DataFrame:
    """A table's columns of a schema, by that many connections at least; each reads rows that lie together, some ROWS at most."""
    _known(schema)
    names = ", ".join(_quoted(f.name) for f in schema)
    with _opened(path) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
    low, size = low or 0, 0 if low is None else high - low + 1
    n = max(1, connections, -(-size // ROWS))
    made = [{DoubleType: float, BooleanType: bool}.get(type(f.dataType), lambda x: x) for f in schema]
    kinds = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            with _opened(path) as db:
                rows = db.execute(f"SELECT {names} FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ?", (low + size * k // n, low + size * (k + 1) // n))
                while some := rows.fetchmany(BATCH):
                    columns = zip(made, zip(*some, strict=True), kinds.types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([None if x is None else make(x) for x in c], kind) for make, c, kind in columns], schema=kinds)

    return spark.range(0, n, 1, n).mapInArrow(read, schema)
