"""Every registered query against its SQL twin at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import duckdb  # noqa: E402
from check import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() == 64 and "mean" in frame.columns


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, FOLDER, name, entry.queries()[name], SQL.get(name))
    assert ok, note
