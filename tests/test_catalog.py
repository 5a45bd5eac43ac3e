"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__
from lodestone import catalog, catalog_tables  # noqa: F401 - the second adds its queries to the first

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(flat, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got or name == "reindex_decision"
    if name in catalog.SQL:
        res = duck.execute(catalog.SQL[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(flat(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_the_entry_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
