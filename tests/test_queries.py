"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lexspark import queries as own
from lexspark import queries_study  # noqa: F401  adds to the catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events orders customer".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(own.ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
