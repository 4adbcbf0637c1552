"""Every query with a SQL twin gives the twin's rows."""

import datetime
import os

import duckdb
import pytest

from textloom.plans import catalog


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for name in os.listdir(data):
        c.sql(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, data, con, name):
    got = catalog.queries()[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert name in catalog.oracle_sql() or rows
    if name in catalog.oracle_sql():
        twin = con.sql(catalog.oracle_sql()[name])
        assert sorted(twin.columns) == columns
        order = [twin.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in order]) for r in twin.fetchall())


def test_entry_has_both_groups():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "bm25_topk" in names
