"""Every registered query with SQL gives the SQL's rows on the smallest data."""

import datetime
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [canon(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    rel = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)

    def table(columns, data):
        return sorted(repr([canon(r[columns.index(c)]) for c in order]) for r in data)

    assert table(df.columns, got) == table(rel.columns, rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
