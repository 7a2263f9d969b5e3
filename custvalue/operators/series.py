"""Daily revenue, its forecast, and running totals of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.dates import (
    CALENDAR_COLUMNS,
    DateLike,
    as_date,
    calendar,
    with_calendar,
)
from custvalue.functions.rounding import half_even
from custvalue.operators.cleaning import NO_SOURCE_NO_LOCATION, NestedVisits, distinct_rows
from custvalue.operators.scoring import Model, score


def daily_revenue(tx: DataFrame | NestedVisits, start: DateLike, end: DateLike) -> DataFrame:
    """Positive revenue per day in [start, end] with calendar features (the date is dropped).

    The filter touches only columns that survive into the distinct, so it goes first and
    reaches the scan.
    """
    in_window = F.col("order_date").between(as_date(start), as_date(end)) & (F.col("value") > 0)
    days = (
        distinct_rows(tx.filter(in_window), NO_SOURCE_NO_LOCATION)
        .groupBy("order_date")
        .agg(F.sum("value").alias("value"))
    )
    return with_calendar(days, "order_date").select("value", *CALENDAR_COLUMNS)


def forecast(spark, start: DateLike, end: DateLike, model: Model) -> DataFrame:
    """Predicted revenue ``label`` for each day of the calendar [start, end]."""
    return score(calendar(spark, start, end), model, "label")


def actual_and_forecast(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Actual and predicted days stacked; the column one side lacks is null."""
    return actual.unionByName(predicted, allowMissingColumns=True)


def cumulative(df: DataFrame, metric: str) -> DataFrame:
    """Running total of ``metric`` by (year, day_of_year), rounded to cents, days numbered from 1.

    The window is unpartitioned: it runs after aggregation, on one row per calendar day.
    """
    in_order = Window.orderBy("year", "day_of_year")
    per_day = df.groupBy("year", "day_of_year").agg(F.sum(metric).alias(metric))
    running = F.sum(metric).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return per_day.select(
        F.row_number().over(in_order).cast("long").alias("days"),
        "year",
        "day_of_year",
        half_even(running, 2).alias(metric),
    )


def cumulative_pairs(totals: DataFrame, metric: str) -> DataFrame:
    """A running total paired with itself on (year, day_of_year).

    Those keys are unique in ``totals``, so each row pairs with itself only and no join is needed.
    """
    return totals.select(
        "days",
        F.col("days").alias("days_x"),
        "year",
        "day_of_year",
        F.col(metric).alias(f"{metric}_x"),
        F.col("days").alias("days_y"),
        F.col(metric).alias(f"{metric}_y"),
    )


def forecast_report(actual_totals: DataFrame, forecast_totals: DataFrame) -> DataFrame:
    """Running forecast and running actual revenue side by side by day number.

    The shorter series is null past its end.
    """
    actual = actual_totals.select("days", F.col("value").alias("transaction_val"))
    predicted = forecast_totals.select("days", F.col("label").alias("prediction_val"))
    return predicted.join(actual, "days", "full").select("days", "prediction_val", "transaction_val")
