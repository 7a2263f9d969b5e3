"""The customers who spend most and least."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.operators.ranks import order_statistics
from custvalue.rules import DEFAULT_RULES, Rules

SIDES = ("top", "low")


def customer_totals(clv: DataFrame) -> DataFrame:
    """Total per customer over all locations, and the customer's number of scored rows."""
    return clv.groupBy("ctc_id").agg(
        F.sum("total_transaction").alias("total_transaction"),
        F.count(F.lit(1)).alias("scored_rows"),
    )


def spender_count(totals: DataFrame, share: float) -> DataFrame:
    """One row: how many customers a side takes, ``share`` of the scored rows rounded half-even."""
    return totals.agg(F.rint(F.sum("scored_rows") * F.lit(share)).cast("long").alias("n"))


def _cut_rank(side: str, n: Column, customers: Column) -> Column:
    """The ascending rank of the last customer that a side takes; 0 if it takes none."""
    if side == "low":
        return n
    return F.when(n < 1, F.lit(0)).otherwise(F.greatest(customers + 1 - n, F.lit(1)))


def _members(
    totals: DataFrame, share: float, sides: Sequence[str], rows: int | None = None
) -> dict[str, Column]:
    """Per side, a predicate true for its first n customers by total, then by ctc_id.

    One exact selection finds the last total of all sides; only these numbers and their counts reach the
    driver. When n cuts through customers with that very total, a second one finds the last id
    among them, so a total shared by many is never sorted as a whole.
    """
    n = spender_count(totals, share).scalar() if rows is None else F.lit(round(rows * share)).cast("long")
    ranks = {side: lambda customers, s=side: _cut_rank(s, n, customers) for side in sides}
    one = totals.select("total_transaction", F.lit(1).alias("one"))
    cut = order_statistics(one, "total_transaction", ranks, ["one"]).first()

    members = {}
    total = F.col("total_transaction")
    for side in sides:
        if cut is None or cut[side] is None:
            members[side] = F.lit(False)
            continue
        rank, below, equal = (cut[f"{side}_{part}"] for part in ("rank", "below", "equal"))
        limit = F.lit(cut[side])
        left = below + equal - rank + 1 if side == "top" else rank - below
        within = total > limit if side == "top" else total < limit
        if left == equal:
            members[side] = within | (total == limit)
            continue
        tied = totals.filter(total == limit).select("ctc_id", F.lit(1).alias("one"))
        last_id = order_statistics(tied, "ctc_id", {"last_id": lambda _, k=left: F.lit(k)}, ["one"])
        members[side] = within | (
            (total == limit) & (F.col("ctc_id") <= F.lit(last_id.first()["last_id"]))
        )
    return members


def spender_flags(
    clv: DataFrame, rules: Rules = DEFAULT_RULES, rows: int | None = None
) -> DataFrame:
    """Totals per customer with ``is_top`` and ``is_low``; both hold when the sides overlap.

    The totals are materialised, since counting and choosing must see the same values. ``rows`` is the
    number of scored rows, if it is known already.
    """
    totals = materialise(customer_totals(clv))
    members = _members(totals, rules.spender_share, SIDES, rows)
    flags = [members[side].alias(f"is_{side}") for side in SIDES]
    return totals.select("ctc_id", "total_transaction", *flags)


def spenders(clv: DataFrame, side: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The ``top`` or ``low`` customers with their totals."""
    totals = materialise(customer_totals(clv))
    chosen = _members(totals, rules.spender_share, [side])[side]
    return totals.filter(chosen).select("ctc_id", "total_transaction")
