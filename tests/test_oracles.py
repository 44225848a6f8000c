"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    want, want_cols = rows([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert "url" in df.columns
    df.take(1)
