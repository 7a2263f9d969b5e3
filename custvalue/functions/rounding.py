"""Rounding, and sums that round the same way whatever the row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(column: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` decimals, ties to the even neighbour.

    ``F.round`` rounds ties away from zero and ``F.bround`` works on the decimal text of the
    number; reports here need the scale, ``rint``, unscale form.
    """
    value = F.col(column) if isinstance(column, str) else column
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def decimal_sum(column: str, digits: int) -> Column:
    """Sum of values that have at most ``digits`` decimals, as a decimal.

    A sum of doubles depends on the order of its rows, so when it lies on a rounding tie the
    partitioning would decide the report. Adding decimals does not.
    """
    return F.sum(F.col(column).cast(f"decimal(28,{digits})"))


def exact_sum(column: str, digits: int) -> Column:
    """:func:`decimal_sum` as a double."""
    return decimal_sum(column, digits).cast("double")


def exact_mean(column: str, digits: int) -> Column:
    """Mean of values that have at most ``digits`` decimals; null without rows."""
    return F.try_divide(exact_sum(column, digits), F.count(column))
