"""Visit features per customer and location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.dates import DateLike, as_date, with_calendar
from custvalue.operators.cleaning import NO_SOURCE, NestedVisits, as_of_date, distinct_rows


def rfm(tx: DataFrame | NestedVisits, as_of: DateLike | None = None) -> DataFrame:
    """Visits, mean value, customer age, recency and days since the last visit.

    One row per (ctc_id, location). ``as_of`` defaults to the latest date of ``tx`` before
    cleaning, and must be given for nested visits, which are cleaned.
    """
    if as_of is None and isinstance(tx, NestedVisits):
        raise ValueError("nested visits do not tell the latest date before cleaning")
    today = as_of_date(tx) if as_of is None else as_date(as_of)
    if isinstance(tx, NestedVisits):  # names only after the shuffle
        rows, location = tx.by_location()
    else:
        rows, location = distinct_rows(tx, NO_SOURCE).withColumnRenamed("location", "at"), F.col("at")
    grouped = rows.groupBy("ctc_id", "at").agg(
        F.count(F.lit(1)).alias("no_visit"),
        F.avg("value").alias("value"),
        F.min("order_date").alias("first_day"),
        F.max("order_date").alias("last_day"),
    )
    return features_of(grouped.withColumn("location", location), today)


def features_of(grouped: DataFrame, today: Column) -> DataFrame:
    """The features from visits, mean value, first and last day per customer and location."""
    return grouped.select(
        "ctc_id",
        "location",
        "no_visit",
        "value",
        F.datediff(today, "first_day").cast("long").alias("customer_age"),
        F.datediff("last_day", "first_day").cast("long").alias("recency"),
        F.datediff(today, "last_day").cast("long").alias("days_since_last_visit"),
    )


def first_visit(clv: DataFrame, as_of: DateLike) -> DataFrame:
    """Scored rows with the date of the first visit and its calendar features."""
    start = F.date_sub(as_date(as_of), F.col("customer_age").cast("int"))
    return with_calendar(clv.withColumn("order_date", start), "order_date")
