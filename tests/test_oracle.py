"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from helixmark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v != v:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = df.collect()
    cur = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert isinstance(catalogue.QUERIES[name](spark, DIR).toPandas(), pd.DataFrame)
