"""Every feed query against its SQL on the smallest tables."""

import os

import pytest

from tidelog.plans import feed_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(feed_queries.QUERIES))
def test_query(spark, duck, name):
    df = feed_queries.QUERIES[name](spark, DATA)
    expected = duck.sql(feed_queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    rows = lambda found, columns: sorted(repr([r[columns.index(c)] for c in order]) for r in found)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)
