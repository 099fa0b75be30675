"""Queries that have SQL give the same rows as DuckDB."""

import duckdb
import pytest

from lexiquarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert rows == sorted(tuple(r[i] for i in at) for r in got.fetchall())
