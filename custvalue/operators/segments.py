"""Seven customer segments per location."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.functions.rounding import decimal_sum, exact_mean, half_even
from custvalue.operators.spenders import SIDES, spender_flags, spenders
from custvalue.rules import DEFAULT_RULES, Rules

# Segment name and the prefix of its columns in the one-segment tables.
PREFIXES = {
    "all": "cus",
    "loyal": "loyal",
    "repeat": "repeat",
    "top": "top",
    "low": "low",
    "risk": "risk",
    "churn": "churn",
}
SEGMENTS = tuple(PREFIXES)
FREQUENCY_DECIMALS = 3
METRICS = ("clv", "aov", "revenue", "users", "frequency")


def churn_frequency(clv: DataFrame) -> DataFrame:
    """One row: mean frequency of the customers who came back, to three decimals."""
    returning = clv.filter(F.col("no_visit") > 1)
    return returning.agg(half_even(exact_mean("frequency", FREQUENCY_DECIMALS), 3).alias("churn_frequency"))


class Facts(NamedTuple):
    """Scalars of the whole scored table."""

    rows: int
    churn_frequency: float | None


def observed(clv: DataFrame) -> tuple[DataFrame, Observation]:
    """``clv`` such that the action that writes it also finds its :class:`Facts`.

    They are counted where the rows are written, so a pass over the written table is saved, and a task that
    runs again counts once. Hand the observation to :func:`facts_of` after the action.
    """
    returning = F.col("no_visit") > 1
    kept = F.when(returning, F.col("frequency")).cast(f"decimal(28,{FREQUENCY_DECIMALS})")
    mean = F.try_divide(F.sum(kept).cast("double"), F.count_if(returning))
    seen = Observation()
    return clv.observe(seen, F.count(F.lit(1)).alias("rows"), half_even(mean, 3).alias("churn_frequency")), seen


def facts_of(seen: Observation) -> Facts:
    """What an action on an :func:`observed` table found."""
    return Facts(**seen.get)


def _metrics(prefix: str) -> list[Column]:
    return [
        F.avg("clv_3m").alias(f"{prefix}clv"),
        F.avg("value").alias(f"{prefix}aov"),
        half_even(F.sum("total_transaction"), 3).alias(f"{prefix}revenue"),
        F.count(F.lit(1)).alias(f"{prefix}users"),
        half_even(exact_mean("frequency", FREQUENCY_DECIMALS), 3).alias(f"{prefix}frequency"),
    ]


def _conditions(clv: DataFrame, rules: Rules, facts: Facts | None = None) -> dict[str, Column]:
    visits, idle = F.col("no_visit"), F.col("days_since_last_visit")
    mean = F.lit(facts.churn_frequency).cast("double") if facts else churn_frequency(clv).scalar()
    limit = rules.churn_factor * mean
    return {
        "all": F.lit(True),
        "loyal": visits >= rules.loyal_visits,
        "repeat": visits >= rules.repeat_visits,
        "risk": idle > rules.risk_factor * F.col("frequency"),
        "churn": (visits > 1) & (idle > limit),
    }


def segment(clv: DataFrame, name: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One segment's metrics per location; columns carry the segment's prefix.

    For the top and low spenders ``clv`` is materialised, so its features are computed once.
    """
    if name in SIDES:
        clv = materialise(clv)  # read for the totals and again for their members
        members = clv.join(spenders(clv, name, rules).select("ctc_id"), "ctc_id", "left_semi")
    else:
        members = clv.filter(_conditions(clv, rules)[name])
    return members.groupBy("location").agg(*_metrics(f"{PREFIXES[name]}_"))


def segments(clv: DataFrame, rules: Rules = DEFAULT_RULES, facts: Facts | None = None) -> DataFrame:
    """All seven segments in one table: segment, location and the five metrics.

    Segments overlap. Rows are first folded per location and membership pattern, and only those
    few sums are repeated for each segment of the pattern. ``clv`` is read three times, or twice with its
    ``facts``; hand in a written or materialised one when it is costly.
    """
    flags = spender_flags(clv, rules, facts.rows if facts else None)
    flagged = clv.join(flags.drop("total_transaction"), "ctc_id")
    conditions = {
        **_conditions(clv, rules, facts),
        "top": F.col("is_top"),
        "low": F.col("is_low"),
    }
    flags = {name: f"in_{name}" for name in SEGMENTS}
    folded = (
        flagged.withColumns({flag: conditions[name] for name, flag in flags.items()})
        .groupBy("location", *flags.values())
        .agg(
            F.sum("clv_3m").alias("clv_3m"),
            F.sum("value").alias("value"),
            F.sum("total_transaction").alias("total_transaction"),
            F.count(F.lit(1)).alias("rows"),
            decimal_sum("frequency", FREQUENCY_DECIMALS).alias("frequency"),
        )
    )
    names = F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in flags.items()])
    rows = F.sum("rows")
    return (
        folded.withColumn("segment", F.explode(names))
        .filter(F.col("segment").isNotNull())
        .groupBy("segment", "location")
        .agg(
            (F.sum("clv_3m") / rows).alias("clv"),
            (F.sum("value") / rows).alias("aov"),
            half_even(F.sum("total_transaction"), 3).alias("revenue"),
            rows.alias("users"),
            half_even(F.sum("frequency").cast("double") / rows, 3).alias("frequency"),
        )
    )


def segments_for_location(segment_rows: DataFrame, location: str) -> DataFrame:
    """One location's segments; a segment without customers there has null metrics.

    ``segment_rows`` is the table of :func:`segments`.
    """
    spark = segment_rows.sparkSession
    names = spark.range(1).select(F.explode(F.lit(list(SEGMENTS))).alias("segment"))
    here = segment_rows.filter(F.col("location") == location)
    return names.join(here, "segment", "left").select(
        "segment", "users", "frequency", "aov", "clv", "revenue"
    )
