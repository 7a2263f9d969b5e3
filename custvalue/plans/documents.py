"""One-row documents for one location, shaped like the answers of the report service.

The field names are the service's own, so a page written for it can read these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.operators.age import age_for_location
from custvalue.operators.period_table import PeriodTables, summary_of_period
from custvalue.operators.periods import Period, tag_periods
from custvalue.operators.segments import SEGMENTS
from custvalue.operators.summary import COMPARED, compare, executive_summary
from custvalue.plans.payload import parallel_arrays
from custvalue.rules import DEFAULT_RULES, Rules

# Field names of the documents.
SEGMENT_FIELDS = {name: f"{name}_cus_clv" for name in SEGMENTS}
SEGMENT_VALUES = ("users", "frequency", "aov", "clv", "revenue")
AGE_FIELDS = {
    "age_category": "age_category",
    "age_category_rev_percentage": "age_cat_revenue_per",
    "avg_clv": "avg_clv_3m",
    "no_cus_age_group": "total_cus",
    "val_of_revenue": "age_cat_total_transaction",
}
UNKNOWN_AGE_FIELDS = {
    "analytics_graph_unknown": "age_cat_revenue_per",
    "unknown_avg_clv": "avg_clv_3m",
    "unknown_tot_cus": "total_cus",
    "unknown_val_of_rev": "age_cat_total_transaction",
}
WEEKDAY_FIELDS = {"day_of_day_of_week": "day_of_week", "transaction_value": "value"}
MAP_FIELDS = {
    "loc_total_transaction": "total_transaction",
    "loc_avg_clv": "avg_clv_3m",
    "loc_avg_loyal_clv": "avg_loyal_clv_3m",
    "loc_loyal_cus_percentage": "loyal_cus_percent",
    "no_new_cus": "no_new_cus",
    "no_repeat_cus": "no_repeat_cus",
    "tot_repeat_transaction": "total_repeat_transaction",
    "latitude": "latitude",
    "longitude": "longitude",
    "map_location": "location",
}
MISSING = "-"


def _one_row(df: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Put one-row, one-column frames side by side, each as a scalar subquery."""
    return df.sparkSession.range(1).select(
        *[part.scalar().alias(name) for name, part in parts.items()]
    )


def age_document(
    analytics: DataFrame, location: str, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Known age categories as arrays in name order, the unknown one as single values."""
    rows = age_for_location(analytics, location, rules)
    known = parallel_arrays(["age_category"], AGE_FIELDS, ~F.col("is_unknown"))
    unknown = [
        F.max(F.when(F.col("is_unknown"), F.col(source))).alias(name)
        for name, source in UNKNOWN_AGE_FIELDS.items()
    ]
    return rows.agg(F.struct(*known.values()).alias("analytics_graph"), *unknown)


def weekday_document(weekday_rows: DataFrame, location: str) -> DataFrame:
    """Weekday numbers and mean values as arrays."""
    here = weekday_rows.filter(F.col("location") == location)
    arrays = parallel_arrays(["day_of_week"], WEEKDAY_FIELDS)
    return here.agg(F.struct(*arrays.values()).alias("revenue_graph"))


def segment_document(segment_rows: DataFrame, location: str, lists: bool = True) -> DataFrame:
    """The five metrics of each segment, as lists (empty when missing) or as values (null)."""
    here = segment_rows.filter(F.col("location") == location)

    def gathered(segment: str, value: str) -> Column:
        own = F.when(F.col("segment") == segment, F.col(value))
        return (F.collect_list(own) if lists else F.max(own)).alias(value)

    return here.agg(
        *[
            F.struct(*[gathered(name, value) for value in SEGMENT_VALUES]).alias(field)
            for name, field in SEGMENT_FIELDS.items()
        ]
    )


def summary_document(
    first_visits: DataFrame, location: str, period: Period, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Current and previous figures of one location; a missing figure reads ``-``."""
    return _figures(compare(executive_summary(tag_periods(first_visits, period), rules), location))


def period_document(
    tables: PeriodTables, location: str, period: Period, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """The document of :func:`summary_document` from the tables of periods, without a customer's row."""
    return _figures(compare(summary_of_period(tables, period, rules), location))


def _figures(figures: DataFrame) -> DataFrame:
    dash = F.parse_json(F.lit(f'"{MISSING}"'))
    names = [f"{name}_{suffix}" for suffix in ("prev", "selected") for name in COMPARED]
    fields = [F.coalesce(F.col(n).cast("variant"), dash).alias(n) for n in names]
    return figures.select(F.struct(*fields).alias("executive_summary"))


def locations_document(location_rows: DataFrame) -> DataFrame:
    """All locations as one sorted array."""
    return location_rows.agg(F.array_sort(F.collect_list("location")).alias("locations"))


def prediction_graph(tables: dict[str, DataFrame]) -> DataFrame:
    """Running actual and forecast revenue, and the location map, as arrays in one struct."""

    def arrays(df: DataFrame, order: str, fields: dict[str, str]) -> DataFrame:
        return df.agg(F.struct(*parallel_arrays([order], fields).values()).alias("part"))

    actual = arrays(tables["actual_totals"], "days", {"transaction_val": "value"})
    predicted = arrays(
        tables["forecast_totals"], "days", {"prediction_val": "label", "day_of_year": "days"}
    )
    places = arrays(tables["location_overview"], "location", MAP_FIELDS)
    parts = _one_row(actual, {"actual": actual, "predicted": predicted, "places": places})
    return parts.select(F.struct("actual.*", "predicted.*", "places.*").alias("prediction_graph"))


def dashboard(
    tables: dict[str, DataFrame],
    location: str,
    period: Period,
    rules: Rules | None = None,
) -> DataFrame:
    """The combined report of one location in one row.

    ``tables`` come from :func:`reports.report_tables` or, better, from published ones; unless
    others are given, the rules are theirs, so all parts of the report go by the same ones.
    """
    rules = rules or getattr(tables, "rules", DEFAULT_RULES)
    whole = {
        "graph": prediction_graph(tables),
        "segments": _packed(segment_document(tables["segments"], location, lists=False)),
        "ages": _packed(age_document(tables["age_analytics"], location, rules)),
        "revenue_graph": weekday_document(tables["weekday_revenue"], location),
        "executive_summary": period_document(
            PeriodTables(tables["period_totals"], tables["period_idle"]), location, period, rules
        ),
    }
    parts = _one_row(tables["segments"], whole)
    return parts.select(
        F.col("graph").alias("prediction_graph"),
        "segments.*",
        "ages.*",
        "revenue_graph",
        "executive_summary",
    )


def _packed(df: DataFrame) -> DataFrame:
    return df.select(F.struct("*").alias("part"))


def as_json(document: DataFrame) -> DataFrame:
    """A one-row document as JSON text in the column ``document``; missing values stay as null."""
    return document.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document")
    )
