"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.registry.sql()


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols and got == want


def test_contract(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7)} <= set(qs)
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_core_does_not_import_the_text_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "logloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "logloom.llm" not in p.read_text(), p
