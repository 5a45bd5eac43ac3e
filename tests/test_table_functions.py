"""SQL table functions against the expressions that they stand for."""

import random

from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.operators import chunks


def test_both_forms_give_the_same_rows(spark):
    rnd = random.Random(9)
    bits = ["# Head one", "####### seven", "###  Third  ", "#", "plain words here", "x" * 900, " \t ", "", "", "\r", "é漢😀 more", "## ", "a\x0bb", " # no heading", "word " * 60]
    rows = [(k, "\n".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25)))) for k in range(200)] + [(900, None), (901, ""), (902, "\x01# A\x02\ntext")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.select(F.col("doc_id").alias("document_id"), "text").createOrReplaceTempView("texts")
    tables.register(spark)
    for name, own, place in (("headed_sections", chunks.section_table(df), "section_index"), ("packed_chunks", chunks.chunk_table(df), "chunk_index")):
        got = spark.sql(f"SELECT document_id, {place}, section, text FROM {name}(TABLE(SELECT document_id, text FROM texts))")
        assert sorted(map(tuple, got.collect())) == sorted((str(r[0]), *r[1:]) for r in own.select("document_id", place, "section", "text").collect())
    assert spark.sql("SELECT * FROM packed_chunks(TABLE(SELECT document_id, text FROM texts WHERE false))").collect() == []
