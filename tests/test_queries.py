"""Every registered query against its SQL twin in DuckDB, and the shape of the plans."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from custvalue.operators import series
from registry.fixtures import Tables, order_visits
from registry.oracle import ORACLE
from registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("nation", "customer", "supplier", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def normal(rows):
    return sorted([tuple(repr(v + 0.0) if isinstance(v, float) else str(v) for v in row) for row in rows])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert operator not in plan
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert normal(df.select(*columns).collect()) == normal(expected)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_only_day_series_meet_in_one_partition(spark):
    """Windows without partitions are for one row per day; nothing else sorts in one task."""
    for name in ("rfm_features", "segments_long", "top_customers", "age_clv_stats", "executive_summary"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        main = plan.split("Subquery")[0]
        assert "SinglePartition" not in main, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tx")
    order_visits(Tables(spark, SF_DIR)).write.parquet(path)
    daily = series.daily_revenue(spark.read.parquet(path), "1997-01-01", "1997-12-31")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = daily._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<ctc_id:bigint,order_date:date,value:double>" in plan
    assert "GreaterThanOrEqual(order_date,1997-01-01)" in plan and "GreaterThan(value,0.0)" in plan
