import datetime as dt

import pytest
from pyspark.sql import functions as F

from custvalue.functions import calendar, exact_mean, exact_sum, half_even, with_calendar
from tests.conftest import rows_of


@pytest.mark.parametrize(
    ("value", "digits", "expected"),
    [
        (0.0005, 3, 0.0), (0.0015, 3, 0.002), (0.0125, 3, 0.012), (2.5, 0, 2.0), (3.5, 0, 4.0),
        (-0.0125, 3, -0.012), (1.2346, 3, 1.235), (None, 3, None),
    ],
)
def test_half_even(spark, value, digits, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(half_even("x", digits)).first()[0] == expected


def test_exact_sum_ignores_row_order(spark):
    values = [0.1, 1e9, 0.2, -1e9, 0.3]
    for order in (values, sorted(values), sorted(values, reverse=True)):
        df = spark.createDataFrame([(v,) for v in order], "x double")
        assert df.agg(exact_sum("x", 4), exact_mean("x", 4)).first()[:] == (0.6, 0.12)


def test_exact_mean_of_nothing_is_null(spark):
    assert spark.createDataFrame([], "x double").agg(exact_mean("x", 3)).first()[0] is None


def test_calendar_features(spark):
    days = spark.createDataFrame([(dt.date(2024, 12, 31),), (dt.date(2021, 5, 3),)], "d date")
    got = rows_of(with_calendar(days, "d"), "month", "year", "day_of_week", "day_of_year")
    assert got == [(12, 2024, 1, 366), (5, 2021, 0, 123)]


def test_calendar_includes_both_ends(spark):
    df = calendar(spark, "2021-05-01", "2022-05-30")
    assert df.count() == 395
    assert df.agg(F.min("year"), F.max("year")).first()[:] == (2021, 2022)


def test_calendar_of_reversed_span_is_empty(spark):
    assert calendar(spark, "2021-05-02", "2021-05-01").count() == 0


def test_calendar_follows_a_table(spark):
    days = spark.createDataFrame([(dt.date(2020, 2, 27),), (dt.date(2020, 3, 1),)], "d date")
    span = calendar(spark, days.agg(F.min("d")).scalar(), days.agg(F.max("d")).scalar())
    assert rows_of(span, "day_of_year") == [(58,), (59,), (60,), (61,)]
