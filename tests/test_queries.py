import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from revlens.plans import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (datetime, date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = own.queries()[name](spark, SF)
    want = duck.sql(own.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    there = sorted((tuple(plain(x) for x in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=key)
    assert have == there and have


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_rows_without_a_twin(spark, name):
    got = own.queries()[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
