"""Summaries from the nodes of days against those from all rows."""

import datetime as dt
import random

import pytest

from custvalue.functions.materialise import materialise
from custvalue.operators.features import first_visit
from custvalue.operators.period_table import PeriodTables, nodes_between, period_tables, summary_of_period
from custvalue.operators.periods import CURRENT, PREVIOUS, Period, select_period, tag_periods
from custvalue.operators.summary import compare, executive_summary
from custvalue.plans import documents
from custvalue.rules import Rules
from tests.conftest import rows_of

TODAY = dt.date(2022, 4, 30)
PERIODS = [
    Period(year=2021), Period(year=2020, month=1), Period(year=2021, month=3), Period(year=1), Period(year=2021, month=13),
    Period(start="2020-02-29", end="2021-02-28"), Period(start="2021-06-01"), Period(), Period(start="2021-01-01", end="2020-01-01"),
    Period(start="2021-3-5", end="2021-03-05"), Period(year=12000), Period(start="0001-01-01", end="9999-12-31"),
]


@pytest.fixture(scope="module")
def visits(spark, make_clv):
    """One location holds most customers and one day a third of them."""
    rng = random.Random(3)
    rows = []
    for ctc_id in range(1_500):
        age = 400 if rng.random() < 0.33 else rng.randrange(0, 900)
        n = rng.choice([1, 1, 2, 2, 3, 9])
        recency = 0 if n == 1 else rng.randrange(0, age + 1)
        rows.append({
            "ctc_id": ctc_id, "location": rng.choice("AAAAAABC"), "no_visit": n, "value": rng.randrange(1, 400) / 8,
            "customer_age": age, "recency": recency, "days_since_last_visit": age - recency,
            "frequency": round(recency / n, 3),
        })
    rows.append({**rows[0], "location": "lonely"})
    return materialise(first_visit(make_clv(*rows), TODAY))


@pytest.fixture(scope="module")
def tables(visits):
    return PeriodTables(*[materialise(table) for table in period_tables(visits)])


def test_nodes_are_the_days(spark):
    rng = random.Random(1)
    for _ in range(300):
        first = rng.randrange(0, 3_000)
        last = first + rng.choice([-1, 0, 1, rng.randrange(0, 3_000)])
        nodes = nodes_between(first, last)
        days = [d for level, slot in nodes for d in range(slot << level, (slot + 1) << level)]
        assert sorted(days) == list(range(first, last + 1))
        assert len(nodes) <= 24 and len(set(nodes)) == len(nodes)
    assert nodes_between(0, 1023) == [(10, 0)]


@pytest.mark.parametrize("period", PERIODS, ids=str)
def test_any_period(visits, tables, period):
    got = summary_of_period(tables, period)
    expected = executive_summary(tag_periods(visits, period))
    numbers = [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows_of(got)]
    assert got.columns == expected.columns
    assert numbers == [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows_of(expected)]


def test_bounds_are_the_predicates(spark, visits):
    for period in PERIODS:
        for which in (CURRENT, PREVIOUS):
            first, last = period.bounds(which)
            inside = visits
            if first is not None:
                inside = inside.filter(visits["order_date"] >= first)
            if last is not None:
                inside = inside.filter(visits["order_date"] <= last)
            assert inside.count() == select_period(visits, period, which).count(), (period, which)


def test_other_rules(visits):
    rules = Rules(repeat_visits=3, churn_factor=1.5)
    tables = period_tables(visits, rules)
    period = Period(year=2021)
    counts = ["period", "location", "total_no_orders", "total_users", "repeat_users", "new_users", "churn_users"]
    expected = executive_summary(tag_periods(visits, period), rules)
    assert rows_of(summary_of_period(tables, period, rules), *counts) == rows_of(expected, *counts)


def test_a_request_reads_no_customer(visits, tables):
    """Filters on level and slot reach the scans, and the document is that of all rows."""
    period = Period(year=2021)
    plan = summary_of_period(tables, period)._jdf.queryExecution().executedPlan().toString()
    assert "ctc_id" not in plan and plan.count("PushedFilters: [Or(") >= 2
    document = documents.as_json(documents.period_document(tables, "A", period)).first()[0]
    assert document == documents.as_json(documents.summary_document(visits, "A", period)).first()[0]
    assert compare(summary_of_period(tables, period), "nowhere").count() == 1


def test_no_rows(visits):
    tables = period_tables(visits.filter("ctc_id < 0"))
    assert summary_of_period(tables, Period()).count() == 0
