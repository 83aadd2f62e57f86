"""Every query with SQL against DuckDB on the smallest tables, the driver's compare in small."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphlake.session import TABLES

DATA = os.environ.get("GLYPHLAKE_TEST_DATA", "/root/testdata/sf0.001")


def shown(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_against_sql(spark, tables, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    found = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
