"""Which texts hold which passages, letter by letter."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import in_turn

#: Characters of passages that are sought in one pass.
BLOCK_CHARS = 4 << 20


def _blocks(passages: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in passages.select("query_id", "question").filter("question is not null").toLocalIterator():
        block.append((r["query_id"], r["question"]))
        size += len(r["question"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id) for each text (id, text) that holds a passage (query_id, question). Nulls hold nothing and are nowhere; an empty passage is everywhere.

    Passages are a bounded block in each pass, sought all at once by one automaton; texts are only scanned.
    """
    kinds = {"query_id": passages.schema["query_id"].dataType, "id": texts.schema["id"].dataType}
    q_type, id_type = (to_arrow_type(k) for k in kinds.values())
    schema = ", ".join(f"{n} {k.simpleString()}" for n, k in kinds.items())

    def one(block: list[tuple]) -> tuple:
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            owners: dict[str, list] = {}
            for q, p in sent.value:
                owners.setdefault(p, []).append(q)
            everywhere = owners.pop("", [])
            automaton = ahocorasick.Automaton()
            for p in owners:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                hits: list[tuple] = []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    if t is not None:
                        found = {p for _, p in automaton.iter(t)} if owners else ()
                        hits += [(q, k) for q in (*everywhere, *(q for p in found for q in owners[p]))]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in hits], q_type), batch.column(0).take(pa.array([k for _, k in hits], pa.int64())).cast(id_type)], ["query_id", "id"])

        return texts.select("id", F.col("text")).mapInArrow(run, schema), sent

    found = in_turn(_blocks(passages), one, "containing")
    return texts.sparkSession.createDataFrame([], schema) if found is None else found
