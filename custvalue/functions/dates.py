"""Calendar features and generated calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR_COLUMNS = ("month", "year", "day_of_week", "day_of_year")

DateLike = Column | str | dt.date


def as_date(value: DateLike) -> Column:
    """A date column from a literal (``date`` or ISO text) or an existing expression."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("date")


def with_calendar(df: DataFrame, date_column: str) -> DataFrame:
    """Add month, year, day_of_week (Monday is 0) and day_of_year of ``date_column``."""
    day = F.col(date_column)
    return df.withColumns(
        {
            "month": F.month(day).cast("long"),
            "year": F.year(day).cast("long"),
            "day_of_week": F.weekday(day).cast("long"),
            "day_of_year": F.dayofyear(day).cast("long"),
        }
    )


def calendar(spark: SparkSession, start: DateLike, end: DateLike) -> DataFrame:
    """Calendar features for each day from ``start`` to ``end``, both included.

    ``start`` and ``end`` may be scalar subqueries, so a calendar can follow the span of a table.
    An ``end`` before ``start`` gives no rows.
    """
    first, last = as_date(start), as_date(end)
    daily = F.sequence(first, last, F.expr("interval 1 day"))
    days = spark.range(1).select(F.explode(F.when(first <= last, daily)).alias("day"))
    return with_calendar(days, "day").select(*CALENDAR_COLUMNS)
