"""Every registered query of the engine itself: it runs on the smallest tables, and equals its oracle."""

import glob
import math
import os

import duckdb
import pytest

from millrace import catalog

from .conftest import SF

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "None" if math.isnan(value) else f"{value:.5f}"
    return f"{value:.5f}" if isinstance(value, int) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    if name not in ORACLES:
        assert found
        return
    made = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(made.columns)
    assert rows(df.columns, found) == rows(made.columns, made.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
