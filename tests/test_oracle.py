"""Every query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

from graphloom.plans import more, oracle, queries

QUERIES, SQL = queries.QUERIES | more.QUERIES, oracle.SQL | more.SQL
D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(data, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    got = rows(df.collect(), df.columns)
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.fetchall(), want.columns)
    else:
        assert got
