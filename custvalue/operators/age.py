"""Revenue and value by age category and location."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.functions.rounding import exact_sum, half_even
from custvalue.operators.cleaning import ALL_COLUMNS, NestedVisits, distinct_rows
from custvalue.operators.ranks import median
from custvalue.operators.scoring import LABEL_DECIMALS
from custvalue.rules import DEFAULT_RULES, Rules

GROUP = ("age_category", "location")


def visits(tx: DataFrame | NestedVisits) -> DataFrame:
    """Value per customer, location, day and source, and ``entries``, how many rows it sums up."""
    sums = F.sum("value").alias("value"), F.count(F.lit(1)).alias("entries")
    if isinstance(tx, NestedVisits):  # names only after the shuffle
        rows, names = tx.by_place()
        folded = rows.groupBy("ctc_id", "order_date", "at").agg(*sums)
        location, source = (names[name].alias(name) for name in ("location", "source"))
        return folded.select("ctc_id", location, "order_date", source, "value", "entries")
    return distinct_rows(tx, ALL_COLUMNS).groupBy("ctc_id", "location", "order_date", "source").agg(*sums)


def with_age(df: DataFrame, contacts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add the age category of cleaned ``contacts``; a customer without one is ``Unknown``.

    A customer with two categories yields two rows per input row.
    """
    joined = df.join(contacts.select("ctc_id", "age_category"), "ctc_id", "left")
    return joined.na.fill(rules.unknown_age, "age_category")


def age_revenue(
    visit_rows: DataFrame, contacts: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Visit rows and value per (age_category, location).

    Visits are folded per customer and location before they meet the contacts, so a customer with
    very many visits reaches the join as a few rows.
    """
    folded = visit_rows.groupBy("ctc_id", "location").agg(
        F.count(F.lit(1)).alias("visit_rows"), F.sum("value").alias("value")
    )
    return (
        with_age(folded, contacts, rules)
        .groupBy(*GROUP)
        .agg(
            F.sum("visit_rows").alias("total_cus"),
            half_even(F.sum("value"), 3).alias("age_cat_total_transaction"),
        )
    )


def age_share(revenue: DataFrame) -> DataFrame:
    """Add each category's percentage of its location, from the rounded sums.

    The window runs over one row per age category of a location.
    """
    location_total = F.sum("age_cat_total_transaction").over(Window.partitionBy("location"))
    part = F.try_divide(F.col("age_cat_total_transaction"), location_total)
    return revenue.withColumn("age_cat_revenue_per", half_even(part, 3) * 100)


def age_clv(clv: DataFrame, contacts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Count, sum, mean, median, min, max and sample deviation of value per age and location.

    The joined values are materialised, as the exact median reads them twice.
    """
    value = "clv_3m"
    aged = with_age(clv.select("ctc_id", "location", value), contacts, rules)
    return median(
        materialise(aged.select(*GROUP, value)),
        value,
        "median_clv_3m",
        GROUP,
        extra=[
            F.count(F.lit(1)).alias("total_clv_cus"),
            exact_sum(value, LABEL_DECIMALS).alias("clv_3m"),
            F.avg(value).alias("avg_clv_3m"),
            F.min(value).alias("min_clv_3m"),
            F.max(value).alias("max_clv_3m"),
            F.stddev_samp(value).alias("std_clv_3m"),
        ],
    )


def age_analytics(
    visit_rows: DataFrame, clv: DataFrame, contacts: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Revenue share and value statistics per (age_category, location)."""
    shares = age_share(age_revenue(visit_rows, contacts, rules))
    stats = age_clv(clv, contacts, rules).withColumn("clv_3m", half_even("clv_3m", 2))
    return shares.join(stats, list(GROUP))


def age_for_location(
    analytics: DataFrame, location: str, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Report columns of one location, with a flag for the unknown category."""
    return analytics.filter(F.col("location") == location).select(
        "age_category",
        (F.col("age_category") == rules.unknown_age).alias("is_unknown"),
        "age_cat_revenue_per",
        "avg_clv_3m",
        "total_cus",
        "age_cat_total_transaction",
    )
