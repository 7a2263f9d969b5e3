"""Executive summary per location, for a period and the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.rounding import exact_mean, half_even
from custvalue.operators.periods import CURRENT, PREVIOUS
from custvalue.rules import DEFAULT_RULES, Rules

GROUPS = ("all", "repeat", "new", "churn")
SUMMARY_COLUMNS = (
    "total_no_orders",
    "avg_revenue_all",
    "avg_clv_all",
    "total_revenue_all",
    "total_users",
    "repeat_users",
    "new_users",
    "churn_users",
)
# Column of the comparison and the summary column behind it.
# Field names of the summary document, without its suffixes.
COMPARED = {
    "customers": "total_users",
    "orders": "total_no_orders",
    "revenue": "total_revenue_all",
    "aov": "avg_revenue_all",
    "new_customers": "new_users",
    "repeat_customers": "repeat_users",
    "churn_customers": "churn_users",
    "aclv_customers": "avg_clv_all",
}


def _with_threshold(rows: DataFrame) -> DataFrame:
    """Add each period's churn frequency, taken over all its locations.

    Spark's own size check decides on a broadcast: two rows after tagging, but ``period`` may be any
    column of the caller's.
    """
    returning = rows.filter(F.col("no_visit") > 1)
    limits = returning.groupBy("period").agg(
        half_even(exact_mean("frequency", 3), 3).alias("churn_frequency")
    )
    return rows.join(limits, "period", "left")


def _member(group: str, rules: Rules) -> Column:
    visits = F.col("no_visit")
    idle_limit = rules.churn_factor * F.col("churn_frequency")
    return {
        "all": F.lit(True),
        "repeat": visits >= rules.repeat_visits,
        "new": visits == 1,
        "churn": F.coalesce(
            (visits > 1) & (F.col("days_since_last_visit") > idle_limit), F.lit(False)
        ),
    }[group]


def _one_period(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with a period column, and the keys the result should show."""
    if "period" in rows.columns:
        return rows, ["period", "location"]
    return rows.withColumn("period", F.lit(CURRENT)), ["location"]


def summary_part(rows: DataFrame, group: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Metrics of one customer group per location, and per period when rows are tagged."""
    tagged, keys = _one_period(rows)
    if group == "churn":
        tagged = _with_threshold(tagged)
    orders = [F.sum("no_visit").alias("total_no_orders")] if group == "all" else []
    users = "total_users" if group == "all" else f"{group}_users"
    return (
        tagged.filter(_member(group, rules))
        .groupBy(*keys)
        .agg(
            *orders,
            F.avg("clv_3m").alias(f"avg_clv_{group}"),
            F.avg("value").alias(f"avg_revenue_{group}"),
            half_even(F.sum("total_transaction"), 3).alias(f"total_revenue_{group}"),
            F.count(F.lit(1)).alias(users),
        )
    )


def executive_summary(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Orders, revenue, value and user counts per location, and per period when rows are tagged.

    A location shows only when it has repeat, new and churned customers in the period; churned
    customers are taken off the total. One conditional aggregate replaces four joined tables.

    The churn threshold takes a pass of its own, so ``rows`` is read twice: hand in rows of a
    written or materialised table.
    """
    tagged, keys = _one_period(rows)
    wide = (
        _with_threshold(tagged)
        .groupBy(*keys)
        .agg(
            F.sum("no_visit").alias("total_no_orders"),
            F.avg("value").alias("avg_revenue_all"),
            F.avg("clv_3m").alias("avg_clv_all"),
            half_even(F.sum("total_transaction"), 3).alias("total_revenue_all"),
            F.count(F.lit(1)).alias("total_users"),
            *[
                F.count_if(_member(group, rules)).alias(f"{group}_users")
                for group in ("repeat", "new", "churn")
            ],
        )
    )
    complete = (F.col("repeat_users") > 0) & (F.col("new_users") > 0) & (F.col("churn_users") > 0)
    return (
        wide.filter(complete)
        .withColumn("total_users", F.col("total_users") - F.col("churn_users"))
        .select(*keys, *SUMMARY_COLUMNS)
    )


def _side_by_side() -> list[Column]:
    def at(period: str, name: str, suffix: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(name))).alias(suffix)

    present = F.count_if(F.col("period") == CURRENT).alias("_present")
    now = [at(CURRENT, source, f"{name}_selected") for name, source in COMPARED.items()]
    before = [at(PREVIOUS, source, f"{name}_prev") for name, source in COMPARED.items()]
    return [present, *now, *before]


def compare(summary: DataFrame, location: str | None = None) -> DataFrame:
    """Current and previous figures in one row per location.

    ``summary`` comes from tagged rows, with at most one row per period and location, so folding
    the two periods together replaces a self-join. Without a current row the previous figures do
    not show either. A named ``location`` always gives a row, all null when it has no current one.
    """
    names = [f"{name}_{suffix}" for suffix in ("selected", "prev") for name in COMPARED]
    if location is None:
        return (
            summary.groupBy("location")
            .agg(*_side_by_side())
            .filter("_present > 0")
            .select("location", *names)
        )
    one = summary.filter(F.col("location") == location).agg(*_side_by_side())
    return one.select(
        F.lit(location).alias("location"),
        *[F.when(F.col("_present") > 0, F.col(name)).alias(name) for name in names],
    )
