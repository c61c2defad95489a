"""Each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quire.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(found):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    assert got
    if name in ORACLE_SQL:
        sql = ORACLE_SQL[name]
        assert sorted(duck.sql(sql).columns) == columns
        assert got == rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
