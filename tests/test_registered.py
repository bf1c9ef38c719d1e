"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import importlib
import os
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
entry = importlib.import_module("__spark_entry__")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def plain(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 5) + 0.0
    return value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
