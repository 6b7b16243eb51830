"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from flowlens.sources.testdata import TABLES

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, exp)


def test_every_query_has_runnable_plan(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        QUERIES[name](spark, SMALL).limit(5).collect()


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["http_method", "http_path"]
    df.collect()
