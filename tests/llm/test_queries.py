import duckdb
import pytest

from textloom.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_on_the_smallest_tables(spark, data, name):
    rows = queries.queries()[name](spark, data).collect()
    assert rows
    if name in oracle.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view web_content as select * from '{data}/web_content.parquet'")
        twin = con.sql(oracle.oracle_sql()[name])
        order = [twin.columns.index(c) for c in rows[0].asDict()]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in order) for r in twin.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.endswith("_found")])
def test_found_rows_are_distinct(spark, data, name):
    got = queries.queries()[name](spark, data)
    assert got.count() == got.distinct().count()
