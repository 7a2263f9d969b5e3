"""Column helpers built from Spark's own functions."""

from custvalue.functions.dates import calendar, with_calendar
from custvalue.functions.rounding import exact_mean, exact_sum, half_even

__all__ = ["calendar", "exact_mean", "exact_sum", "half_even", "with_calendar"]
