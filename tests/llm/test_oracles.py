"""Queries that SQL can express, against DuckDB over the whole tables."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    out = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(out.fetchall(), key=repr)
