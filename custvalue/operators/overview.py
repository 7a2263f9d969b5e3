"""Value overview per location, with map coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.rounding import half_even
from custvalue.rules import DEFAULT_RULES, Rules

GROUPS = ("all", "loyal", "new", "repeat")


def _member(group: str, rules: Rules) -> Column:
    visits = F.col("no_visit")
    return {
        "all": F.lit(True),
        "loyal": visits >= rules.loyal_visits,
        "new": visits == 1,
        "repeat": visits > 1,
    }[group]


def _metrics(group: str, member: Column) -> list[Column]:
    def kept(name: str) -> Column:
        return F.col(name) if group == "all" else F.when(member, F.col(name))

    infix = "" if group == "all" else f"{group}_"
    total = F.sum(kept("total_transaction"))
    count_name = "total_customer" if group == "all" else f"no_{group}_cus"
    return [
        F.avg(kept("clv_3m")).alias(f"avg_{infix}clv_3m"),
        F.avg(kept("value")).alias(f"avg_{infix}transaction"),
        (half_even(total, 3) if group == "all" else total).alias(f"total_{infix}transaction"),
        F.count_if(member).alias(count_name),
    ]


def overview(clv: DataFrame, group: str = "all", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Mean value, mean spend, total and customers per location for one customer group."""
    member = _member(group, rules)
    return clv.filter(member).groupBy("location").agg(*_metrics(group, member))


def location_overview(clv: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The four groups side by side, for locations that have loyal, new and repeat customers.

    One conditional aggregate over one scan; keeping only locations where every count is positive
    is the same as joining the four group tables.
    """
    metrics = [m for group in GROUPS for m in _metrics(group, _member(group, rules))]
    wide = clv.groupBy("location").agg(*metrics)
    complete = (F.col("no_loyal_cus") > 0) & (F.col("no_new_cus") > 0) & (F.col("no_repeat_cus") > 0)
    share = half_even(F.col("no_loyal_cus") / F.col("total_customer"), 3) * 100
    return wide.filter(complete).withColumn("loyal_cus_percent", share)


def with_geo(overview_rows: DataFrame, geo: DataFrame) -> DataFrame:
    """Add coordinates; locations without any are left out.

    Both sides hold one row per location. There is no broadcast hint: Spark broadcasts ``geo``
    when its size allows and shuffles otherwise.
    """
    places = geo.select(
        "location",
        half_even("latitude", 3).alias("latitude"),
        half_even("longitude", 3).alias("longitude"),
    )
    return overview_rows.join(places, "location")


def locations(tx: DataFrame) -> DataFrame:
    """The locations that occur in the transactions."""
    return tx.select("location").na.drop().distinct()
