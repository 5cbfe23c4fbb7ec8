"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if not n.startswith("op")])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n not in ORACLES and not n.startswith("op") and n != "pipeline"])
def test_rows_without_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
