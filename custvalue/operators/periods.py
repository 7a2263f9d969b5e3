"""The period of a summary and the period before it.

A period selects customers by the date of their first visit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.dates import as_date
from custvalue.rules import DEFAULT_RULES, Rules

CURRENT, PREVIOUS = "current", "previous"


@dataclass(frozen=True)
class Period:
    """A date range, a year, a month of a year, or (all fields unset) every row."""

    start: str | None = None
    end: str | None = None
    year: int | None = None
    month: int | None = None

    @classmethod
    def from_params(
        cls,
        year: int | str | None = None,
        month: int | str | None = None,
        start: str | None = None,
        end: str | None = None,
        rules: Rules = DEFAULT_RULES,
    ) -> Period:
        """Read request parameters; ``None`` means not given, and blank differs from that.

        A given start, even a blank one, switches year and month off. An end counts only beside
        a start. A year or month below 1 selects every row, except that month 0 is the whole year.
        """
        if start is not None:
            first, last = start.strip(), (end or "").strip()
            return cls(start=first, end=last or None) if first else cls()
        chosen_year = rules.default_year if year is None else int(year)
        chosen_month = 0 if month is None else int(month)
        if chosen_year <= 0 or chosen_month < 0:
            return cls()
        return cls(year=chosen_year, month=chosen_month or None)

    def current(self) -> Column:
        """Predicate on order_date, year and month of the first visit."""
        if self.start:
            return _in_range(as_date(self.start), self.end and as_date(self.end))
        return _in_month(self.year, self.month)

    def previous(self) -> Column:
        """The same for the period before: a year earlier, or the month before."""
        if self.start:
            first = F.add_months(as_date(self.start), -12)
            return _in_range(first, self.end and F.add_months(as_date(self.end), -12))
        if self.year and self.month:
            month_before = self.month - 1
            return (
                _in_month(self.year, month_before)
                if month_before
                else _in_month(self.year - 1, 12)
            )
        return _in_month(self.year and self.year - 1, None)

    def bounds(self, which: str = CURRENT) -> tuple[Column | None, Column | None]:
        """First and last day of the current or the previous period; ``None`` is no limit on that side."""
        before = which == PREVIOUS
        if self.start:
            first, last = as_date(self.start), as_date(self.end) if self.end else None
            if before:
                first, last = F.add_months(first, -12), None if last is None else F.add_months(last, -12)
            return first, last
        if self.year is None:
            return None, None
        if not self.month:
            return _days_of(self.year - before, 1, 12)
        if not before:
            return _days_of(self.year, self.month, self.month)
        month = self.month - 1
        return _days_of(self.year, month, month) if month else _days_of(self.year - 1, 12, 12)


# The bounds of a period that no date can lie in.
NO_DAY = ("0001-01-02", "0001-01-01")


def _days_of(year: int, first: int, last: int) -> tuple[Column, Column]:
    """From the first day of a month to the last day of another in the same year."""
    if not (1 <= year <= 9999 and 1 <= first <= last <= 12):
        return as_date(NO_DAY[0]), as_date(NO_DAY[1])
    return as_date(f"{year:04}-{first:02}-01"), F.last_day(as_date(f"{year:04}-{last:02}-01"))


def _in_range(first: Column, last: Column | None) -> Column:
    """Days from ``first`` on, up to ``last``. The bounds on the year let a table laid out by
    year skip whole partitions."""
    day, year = F.col("order_date"), F.col("year")
    since = (year >= F.year(first)) & (day >= first)
    return since if last is None else since & (year <= F.year(last)) & (day <= last)


def _in_month(year: int | None, month: int | None) -> Column:
    if year is None:
        return F.lit(True)
    same_year = F.col("year") == year
    return same_year if month is None else same_year & (F.col("month") == month)


def select_period(first_visits: DataFrame, period: Period, which: str = CURRENT) -> DataFrame:
    """First-visit rows of the current or the previous period."""
    return first_visits.filter(period.current() if which == CURRENT else period.previous())


def tag_periods(first_visits: DataFrame, period: Period) -> DataFrame:
    """First-visit rows tagged ``current`` or ``previous``, from one scan.

    Windows may overlap; a row in both comes out twice.
    """
    now, before = period.current(), period.previous()
    tags = F.array(F.when(now, F.lit(CURRENT)), F.when(before, F.lit(PREVIOUS)))
    tagged = first_visits.filter(now | before).withColumn("period", F.explode(tags))
    return tagged.filter(F.col("period").isNotNull())
