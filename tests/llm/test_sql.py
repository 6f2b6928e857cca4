"""Queries of the text operators that have SQL, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from maskframe.llm import registry


def test_queries_are_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
