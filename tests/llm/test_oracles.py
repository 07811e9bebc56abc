"""The queries of the text operators that have SQL, against DuckDB."""

import duckdb
import pytest

from palimpsest.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    d = duckdb.connect()
    for t in ("documents", "benchmark"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    want = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
