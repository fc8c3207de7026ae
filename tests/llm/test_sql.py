"""Queries of the subpackage that have SQL against DuckDB."""

import duckdb
import pytest

from quillmill.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_equals_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        want = db.sql(oracle.oracle_sql()[name])
        columns = sorted(want.columns)
        expected = sorted(map(str, want.select(*columns).fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == expected
