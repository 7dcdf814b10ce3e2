"""Every registered query runs, and gives what its SQL gives in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from citemill import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(name, spark, duck):
    found = registry.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted(repr([r[c] for c in columns]) for r in found.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        wanted = duck.sql(sql)
        assert sorted(wanted.columns) == columns
        assert got == sorted(repr([dict(zip(wanted.columns, r))[c] for c in columns]) for r in wanted.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, SF_DIR).count() == 10
