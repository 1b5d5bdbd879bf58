"""The registered queries against their SQL twins."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf, name):
    got, want = entry.queries()[name](spark, sf), duck.sql(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["masked", "members"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
