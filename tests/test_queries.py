"""Every registered query that has SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from quillmill.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in registry.queries() if n in registry.oracle_sql()]


def value(v):
    if v is None or v != v:
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    with duckdb.connect() as db:
        for file in os.listdir(DATA):
            db.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
        want = db.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        expected = sorted(tuple(map(value, r)) for r in want.select(*columns).fetchall())
    assert sorted(tuple(map(value, r)) for r in got.select(*columns).collect()) == expected
