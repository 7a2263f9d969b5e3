"""Any period's summary from a small table, without reading customers.

The days of the first visits are the leaves of a binary tree: a node of level k stands for 2 ** k days in
a row. Every node holds its customers' counts and sums per location, and per number of idle days the
customers who came back and have been idle for that long or longer. A period is the union of few nodes, two
per level at most, so its counts, sums and churn threshold are sums over these nodes, and its churned
customers are one row of each: that of the fewest idle days above the limit. Adding nodes, rather than
taking one running sum from another, keeps the sums of amounts as exact as summing the rows.

The tables have at most ``locations * days * idle days`` rows per level, however many customers there are.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.functions.rounding import decimal_sum, half_even
from custvalue.operators.periods import CURRENT, PREVIOUS, Period
from custvalue.operators.summary import SUMMARY_COLUMNS
from custvalue.rules import DEFAULT_RULES, Rules

DAY_ZERO = -719_162  # 0001-01-01, in days from 1970-01-01
NODE = ("location", "level", "slot")
FREQUENCY_DECIMALS = 3


class PeriodTables(NamedTuple):
    """``totals``: one row per location and node. ``idle``: also per number of idle days."""

    totals: DataFrame
    idle: DataFrame


def day_number(day: Column) -> Column:
    return F.unix_date(day).cast("long") - DAY_ZERO


def period_tables(first_visits: DataFrame, rules: Rules = DEFAULT_RULES) -> PeriodTables:
    """Fold the rows of first visits into the nodes of all levels.

    Rows are folded per location, day and idle days first, so a busy location or day reaches the levels as
    few rows. The last level is the first at which one node holds all days. The windows run over the idle
    days of one node.
    """
    visits, returning = F.col("no_visit"), F.col("no_visit") > 1
    cells = materialise(
        first_visits.groupBy(
            "location", day_number(F.col("order_date")).alias("day"), F.col("days_since_last_visit").alias("idle")
        ).agg(
            F.count(F.lit(1)).alias("users"),
            F.sum("no_visit").alias("orders"),
            F.sum("clv_3m").alias("clv_3m"),
            F.sum("value").alias("value"),
            F.sum("total_transaction").alias("total_transaction"),
            F.count_if(visits >= rules.repeat_visits).alias("repeat_users"),
            F.count_if(visits == 1).alias("new_users"),
            F.count_if(returning).alias("came_back"),
            # A sum over no rows is null, and adds nothing later.
            F.sum(F.when(returning, F.col("frequency")).cast(f"decimal(28,{FREQUENCY_DECIMALS})")).alias("frequency"),
        )
    )
    first, last = cells.agg(F.min("day"), F.max("day")).first()
    top = (first ^ last).bit_length() if first is not None else 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    slot = F.expr("shiftright(day, level)").alias("slot")
    nodes = cells.select("*", levels).select("*", slot)
    totals = nodes.groupBy(*NODE).agg(
        *[F.sum(c).alias(c) for c in ("users", "orders", "clv_3m", "value", "total_transaction")],
        *[F.sum(c).alias(c) for c in ("repeat_users", "new_users", "came_back")],
        decimal_sum("frequency", FREQUENCY_DECIMALS).alias("frequency"),
    )
    counted = nodes.where(F.col("came_back") > 0).groupBy(*NODE, "idle").agg(F.sum("came_back").alias("rows"))
    longest_first = Window.partitionBy(*NODE).orderBy(F.desc("idle")).rowsBetween(Window.unboundedPreceding, 0)
    idle = counted.select(*NODE, "idle", F.sum("rows").over(longest_first).alias("at_least"))
    return PeriodTables(_sorted(totals), _sorted(idle))


def _sorted(table: DataFrame) -> DataFrame:
    """Rows of one node side by side, so that a stored table is read where its nodes are."""
    return table.repartitionByRange("level", "slot").sortWithinPartitions("level", "slot", "location")


def nodes_between(first: int, last: int) -> list[tuple[int, int]]:
    """The ``(level, slot)`` of the fewest nodes that make up the days from ``first`` to ``last``."""
    found = []
    for level in range(last.bit_length() + 1):
        # The whole nodes of this level inside the period are left, left + 1, ..., right - 1.
        left, right = -(-first >> level), last + 1 >> level
        if left >= right:
            break
        if left % 2:
            found.append((level, left))
        if right % 2:
            found.append((level, right - 1))
    return found


def period_nodes(totals: DataFrame, period: Period) -> dict[str, list[tuple[int, int]]]:
    """The nodes of the current and the previous period; none where it has no day of the tables.

    Periods are cut to the days that occur, so they need no node above the tables' last level.
    """
    bounds = [day for which in (CURRENT, PREVIOUS) for day in period.bounds(which)]
    limits = [F.lit(None) if day is None else F.max(day_number(day)) for day in bounds]
    leaves = totals.where(F.col("level") == 0)
    low, high, *days = leaves.agg(F.min("slot"), F.max("slot"), *limits).first()
    nodes = {CURRENT: [], PREVIOUS: []}
    if low is not None:
        for which, first, last in zip(nodes, days[::2], days[1::2], strict=True):
            first = low if first is None else max(first, low)
            last = high if last is None else min(last, high)
            nodes[which] = nodes_between(first, last) if first <= last else []
    return nodes


def _in(nodes: list[tuple[int, int]]) -> Column:
    slots: dict[int, list[int]] = {}
    for level, slot in nodes:
        slots.setdefault(level, []).append(slot)
    parts = [(F.col("level") == level) & F.col("slot").isin(chosen) for level, chosen in slots.items()]
    return reduce(or_, parts, F.lit(False))


def summary_of_period(tables: PeriodTables, period: Period, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The executive summary of a period and the one before, as from all tagged rows.

    Filters on level and slot reach the scan of stored tables. ``rules.repeat_visits`` is that which the
    tables were built by; the churn factor may differ.
    """
    nodes = {which: _in(found) for which, found in period_nodes(tables.totals, period).items()}

    def chosen(table: DataFrame) -> DataFrame:
        tags = F.array(*[F.when(inside, F.lit(which)) for which, inside in nodes.items()])
        picked = table.where(reduce(or_, nodes.values())).withColumn("period", F.explode(tags))
        return picked.where(F.col("period").isNotNull())

    totals = chosen(tables.totals)
    mean = F.try_divide(F.sum("frequency").cast("double"), F.sum("came_back"))
    limits = totals.groupBy("period").agg((half_even(mean, FREQUENCY_DECIMALS) * rules.churn_factor).alias("limit"))
    # At most one row of a node has the fewest idle days above the limit: that of the most customers.
    beyond = chosen(tables.idle).join(limits, "period").where(F.col("idle") > F.col("limit"))
    churned = beyond.groupBy("period", *NODE).agg(F.max("at_least").alias("churned"))
    churned = churned.groupBy("period", "location").agg(F.sum("churned").alias("churn_users"))
    users = F.sum("users")
    wide = totals.groupBy("period", "location").agg(
        F.sum("orders").alias("total_no_orders"),
        (F.sum("value") / users).alias("avg_revenue_all"),
        (F.sum("clv_3m") / users).alias("avg_clv_all"),
        half_even(F.sum("total_transaction"), 3).alias("total_revenue_all"),
        users.alias("total_users"),
        F.sum("repeat_users").alias("repeat_users"),
        F.sum("new_users").alias("new_users"),
    )
    whole = wide.join(churned, ["period", "location"])
    shown = whole.where((F.col("repeat_users") > 0) & (F.col("new_users") > 0) & (F.col("churn_users") > 0))
    return shown.withColumn("total_users", F.col("total_users") - F.col("churn_users")).select(
        "period", "location", *SUMMARY_COLUMNS
    )
