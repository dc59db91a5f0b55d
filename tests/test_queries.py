"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in contract.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = database.sql(sql)
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
