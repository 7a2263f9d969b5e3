"""Queries against their SQL twins in DuckDB."""

import duckdb
import pytest

from custvalue.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF


@pytest.mark.parametrize("path", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name, path):
    df = QUERIES[name](spark, path)
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    twin = connection.execute(ORACLE[name])
    columns = [c[0] for c in twin.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(twin.fetchall(), key=repr)
