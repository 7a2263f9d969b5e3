"""Revenue by weekday and location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.dates import CALENDAR_COLUMNS, with_calendar
from custvalue.functions.rounding import half_even


def daily_location(visits: DataFrame) -> DataFrame:
    """Rows and mean value per day and location with calendar features (the date is dropped).

    ``visits`` come from :func:`custvalue.operators.age.visits`: their sums and row counts give the
    mean over the distinct transactions without another distinct pass.
    """
    entries = F.sum("entries")
    daily = visits.groupBy("order_date", "location").agg(
        entries.alias("total_cus"), half_even(F.sum("value") / entries, 3).alias("value")
    )
    return with_calendar(daily, "order_date").select(
        "location", "total_cus", "value", *CALENDAR_COLUMNS
    )


def weekday_revenue(visits: DataFrame) -> DataFrame:
    """Rows, and the mean of the rounded daily means, per weekday and location."""
    return (
        daily_location(visits)
        .groupBy("day_of_week", "location")
        .agg(F.sum("total_cus").alias("total_cus"), F.avg("value").alias("value"))
    )


def weekday_for_location(weekday_rows: DataFrame, location: str) -> DataFrame:
    """One location's weekdays, Monday first."""
    return (
        weekday_rows.filter(F.col("location") == location)
        .select("day_of_week", "value")
        .orderBy("day_of_week")
    )
