"""Every registered survey query against its SQL in DuckDB, and the entry points."""

import duckdb
import pytest

import __spark_entry__
from kinfold.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "customer", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 500
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
