"""Queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from terrastack.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, TABLES)
    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
        want = con.sql(ORACLES[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        expected = sorted([plain(v) for v in r] for r in want.select(*columns).fetchall())
    assert sorted([plain(v) for v in r] for r in got.select(*columns).collect()) == expected and expected
