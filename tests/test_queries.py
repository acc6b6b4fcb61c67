"""Every query with SQL gives the same rows in DuckDB, on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom import plans

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "inf" if math.isinf(value) else f"{value:.7g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, duck, name):
    df = plans.queries()[name](spark, D)
    found = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, name):
    assert plans.queries()[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
