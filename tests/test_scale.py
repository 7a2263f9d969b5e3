"""Skewed inputs: results stay whole, and no task gets the hot group."""

import pytest
from pyspark.sql import functions as F

from custvalue.functions.files import exists
from custvalue.functions.materialise import ensure_checkpoint_dir, materialise, scratch
from custvalue.operators import age, cleaning, features
from tests.conftest import rows_of

HOT_ROWS = 40_000


@pytest.fixture(scope="module")
def hot_tx(spark):
    """One customer holds a third of the rows, and one row is copied as often again."""
    ids = spark.range(3 * HOT_ROWS)
    day = F.expr("date_add(date'2020-01-01', cast(id % 700 as int))")
    kind = F.col("id") % 3
    return ids.select(
        F.when(kind == 0, 1).when(kind == 1, 2).otherwise(F.col("id") + 10).alias("ctc_id"),
        F.when(kind == 1, F.lit("2021-01-01").cast("date")).otherwise(day).alias("order_date"),
        F.concat(F.lit("s"), F.when(kind == 1, 0).otherwise(F.col("id") % 2)).alias("source"),
        F.concat(F.lit("P"), F.when(kind == 1, 0).otherwise(F.col("id") % 7)).alias("location"),
        F.when(kind == 1, 5.0).otherwise(F.col("id").cast("double")).alias("value"),
    )


def test_copies_and_busy_customers_are_counted_whole(hot_tx):
    rfm = features.rfm(hot_tx)
    visits = {r.ctc_id: r.n for r in rfm.filter("ctc_id <= 2").groupBy("ctc_id")
              .agg(F.sum("no_visit").alias("n")).collect()}
    assert visits == {1: HOT_ROWS, 2: 1}
    assert rfm.count() == HOT_ROWS + 7 + 1


def test_copies_are_folded_before_the_shuffle(hot_tx):
    distinct = cleaning.distinct_rows(hot_tx)
    plan = distinct._jdf.queryExecution().executedPlan().toString()
    after, _, before = plan.partition("Exchange hashpartitioning")
    assert "HashAggregate" in after and "HashAggregate" in before
    keys = before.split("\n")[0]
    assert all(name in keys for name in cleaning.ALL_COLUMNS)


def test_busy_customer_is_split_when_contacts_are_too_large_to_broadcast(spark, hot_tx):
    contacts = spark.range(1, 5_000).select(F.col("id").alias("ctc_id"), F.lit("18-24").alias("age_category"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        aged = age.with_age(hot_tx, contacts).groupBy("age_category").agg(F.count("*"), F.sum("value"))
        got = rows_of(aged)
        plan = aged._jdf.queryExecution().executedPlan()
        aged.collect()
        text = plan.toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    known = F.col("ctc_id") < 5_000
    names = F.when(known, "18-24").otherwise("Unknown")
    assert got == rows_of(hot_tx.groupBy(names).agg(F.count("*"), F.sum("value")))
    assert "skew=true" in text


def test_stored_tables_live_in_the_checkpoint_folder(spark):
    df = spark.range(5)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    table = materialise(df)
    assert table.inputFiles() and all(folder in file for file in table.inputFiles())
    assert rows_of(table) == rows_of(df)


def test_a_jobs_tables_go_at_its_end_also_on_failure(spark):
    with scratch(spark) as folder:
        inner = materialise(spark.range(5))
        assert inner.count() == 5 and exists(spark, folder)
    assert not exists(spark, folder)
    with pytest.raises(RuntimeError), scratch(spark) as folder:
        materialise(spark.range(5))
        raise RuntimeError
    assert not exists(spark, folder)
    assert folder not in materialise(spark.range(1)).inputFiles()[0]
