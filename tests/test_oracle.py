"""Every registered query against its SQL equivalent in DuckDB, on the same tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry
from dayweave.plans.oracle import ORACLE
from dayweave.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


# Statistics of these models are compared with plain code in test_series.py.
NO_SQL = {"var_granger", "var_responses"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF_DIR)
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = _rows(columns, want.fetchall())
    actual = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(actual) == len(expected) > 0
    different = [(a, b) for a, b in zip(actual, expected, strict=True) if a != b]
    assert not different, f"{len(different)} rows differ, first {different[:3]}"


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) - NO_SQL


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
