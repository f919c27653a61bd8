"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from strandlake.plans import catalogue, pipelines, results  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "benchmark", "conversations", "customer", "nation", "region", "part", "supplier"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows
    if name in catalogue.ORACLES:
        wanted = duck.sql(catalogue.ORACLES[name])
        assert sorted(wanted.columns) == columns
        assert rows == sorted(wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)
