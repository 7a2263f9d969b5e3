import datetime as dt

import pytest
from pyspark.sql import functions as F

from custvalue.operators import summary
from custvalue.operators.features import first_visit
from custvalue.operators.periods import CURRENT, PREVIOUS, Period, select_period, tag_periods
from tests.conftest import rows_of

AS_OF = "2022-04-30"


def visits(make_clv, *rows):
    """First-visit rows: the customer age puts the first visit on the given day."""
    today = dt.date.fromisoformat(AS_OF)
    filled = [
        {**row, "customer_age": (today - dt.date.fromisoformat(row.pop("day"))).days} for row in rows
    ]
    return first_visit(make_clv(*filled), AS_OF)


@pytest.fixture(scope="module")
def calendar_rows(make_clv):
    days = ["2019-12-31", "2020-01-05", "2020-02-28", "2020-02-29", "2020-12-15", "2021-01-20",
            "2021-02-28", "2021-03-01", "2021-05-05", "2022-01-03"]
    return visits(make_clv, *[{"ctc_id": i, "location": "A", "day": d} for i, d in enumerate(days)])


ALL_IDS = list(range(10))


@pytest.mark.parametrize(
    ("params", "current", "previous"),
    [
        ({}, [5, 6, 7, 8], [1, 2, 3, 4]),
        ({"year": 2020}, [1, 2, 3, 4], [0]),
        ({"year": "2020", "month": "2"}, [2, 3], [1]),
        ({"year": 2021, "month": 1}, [5], [4]),
        ({"month": 2}, [6], [5]),
        ({"start": "2021-01-01", "end": "2021-02-28", "year": 2019, "month": 3}, [5, 6], [1, 2]),
        ({"start": "2021-03-01"}, [7, 8, 9], [4, 5, 6, 7, 8, 9]),
        ({"end": "2020-06-01"}, [5, 6, 7, 8], [1, 2, 3, 4]),
        ({"start": "  "}, ALL_IDS, ALL_IDS),
        ({"year": 0}, ALL_IDS, ALL_IDS),
        ({"year": -5, "month": 3}, ALL_IDS, ALL_IDS),
        ({"start": "", "year": 2020}, ALL_IDS, ALL_IDS),
        ({"start": "2021-03-01", "end": " "}, [7, 8, 9], [4, 5, 6, 7, 8, 9]),
        ({"start": "2020-02-29 00:00:00", "end": "2020-12-31 00:00:00"}, [3, 4], [0]),
        # No such month; the one before it is December 2021, without first visits.
        ({"month": 13}, [], []),
    ],
)
def test_period_rules(calendar_rows, params, current, previous):
    period = Period.from_params(**params)
    ids = {
        which: sorted(r.ctc_id for r in select_period(calendar_rows, period, which).collect())
        for which in (CURRENT, PREVIOUS)
    }
    assert ids == {CURRENT: current, PREVIOUS: previous}
    tagged = tag_periods(calendar_rows, period)
    for which, expected in ids.items():
        assert [r.ctc_id for r in tagged.filter(F.col("period") == which).orderBy("ctc_id").collect()] == expected


def test_a_year_before_leap_day_is_28_february(make_clv):
    rows = visits(make_clv, {"ctc_id": 1, "location": "A", "day": "2019-02-28"},
                  {"ctc_id": 2, "location": "A", "day": "2019-03-01"})
    period = Period.from_params(start="2020-02-29", end="2020-02-29")
    assert rows_of(select_period(rows, period, PREVIOUS), "ctc_id") == [(1,)]


def cohort(day, location, first_id, new=1, lazy=1, active=1):
    """New customers, returning ones who stopped coming, and returning ones who still come."""
    groups = [
        (new, {"no_visit": 1, "value": 10}),
        (lazy, {"no_visit": 2, "value": 20, "frequency": 4, "days_since_last_visit": 100}),
        (active, {"no_visit": 3, "value": 60, "frequency": 6, "days_since_last_visit": 15}),
    ]
    rows = [dict(kind) for count, kind in groups for _ in range(count)]
    return [{**row, "ctc_id": first_id + i, "location": location, "day": day} for i, row in enumerate(rows)]


@pytest.fixture(scope="module")
def cohorts(make_clv):
    return visits(
        make_clv,
        *cohort("2021-03-03", "A", 0),
        *cohort("2020-06-06", "A", 10, new=2, active=2),
        *cohort("2021-04-04", "B", 20, new=0),
        *cohort("2021-04-04", "C", 30),
        *cohort("2020-04-04", "C", 40, lazy=0),
        *cohort("2020-04-04", "D", 50),
    )


def test_parts(cohorts):
    tagged = tag_periods(cohorts, Period.from_params(year=2021))
    here = (F.col("period") == CURRENT) & (F.col("location") == "A")
    part = {g: summary.summary_part(tagged, g).filter(here).first() for g in summary.GROUPS}
    assert part["all"].asDict() == {
        "period": CURRENT, "location": "A", "total_no_orders": 6, "avg_clv_all": 30.0,
        "avg_revenue_all": 30.0, "total_revenue_all": 90.0, "total_users": 3,
    }
    assert part["repeat"].repeat_users == 2 and part["repeat"].total_revenue_repeat == 80.0
    assert part["new"].new_users == 1 and part["new"].avg_clv_new == 10.0
    assert part["churn"].churn_users == 1 and part["churn"].avg_revenue_churn == 20.0


def test_summary_drops_incomplete_locations(cohorts):
    got = summary.executive_summary(tag_periods(cohorts, Period.from_params(year=2021)))
    columns = ["period", "location", "total_no_orders", "total_revenue_all", "total_users",
               "repeat_users", "new_users", "churn_users"]
    # B has no new customer in 2021, C no churned one in 2020.
    assert rows_of(got, *columns) == [
        (CURRENT, "A", 6, 90.0, 2, 2, 1, 1),
        (CURRENT, "C", 6, 90.0, 2, 2, 1, 1),
        (PREVIOUS, "A", 10, 160.0, 4, 3, 2, 1),
        (PREVIOUS, "D", 6, 90.0, 2, 2, 1, 1),
    ]


def test_untagged_rows_are_one_period(cohorts):
    rows = select_period(cohorts, Period.from_params(year=2021))
    got = summary.executive_summary(rows)
    assert got.columns == ["location", *summary.SUMMARY_COLUMNS]
    assert rows_of(got, "location") == [("A",), ("C",)]


def test_threshold_is_per_period_over_all_locations(make_clv):
    rows = visits(
        make_clv,
        {"ctc_id": 1, "location": "A", "day": "2021-01-01", "no_visit": 2, "frequency": 1,
         "days_since_last_visit": 20},
        {"ctc_id": 2, "location": "B", "day": "2021-01-01", "no_visit": 2, "frequency": 11,
         "days_since_last_visit": 18},
        {"ctc_id": 3, "location": "A", "day": "2020-01-01", "no_visit": 2, "frequency": 2,
         "days_since_last_visit": 7},
    )
    got = summary.summary_part(tag_periods(rows, Period.from_params(year=2021)), "churn")
    # 2021: mean 6, limit 18. 2020: mean 2, limit 6.
    assert rows_of(got, "period", "location", "churn_users") == [(CURRENT, "A", 1), (PREVIOUS, "A", 1)]


def test_period_without_returning_customers_gives_nothing(make_clv):
    rows = visits(make_clv, {"ctc_id": 1, "location": "A", "day": "2021-01-01"})
    tagged = tag_periods(rows, Period.from_params(year=2021))
    assert summary.summary_part(tagged, "churn").count() == 0
    assert summary.executive_summary(tagged).count() == 0


def test_compare(cohorts):
    got = summary.executive_summary(tag_periods(cohorts, Period.from_params(year=2021)))
    shown = ["location", "customers_selected", "orders_selected", "customers_prev", "orders_prev"]
    assert rows_of(summary.compare(got), *shown) == [("A", 2, 6, 4, 10), ("C", 2, 6, None, None)]
    assert rows_of(summary.compare(got, "C"), *shown) == [("C", 2, 6, None, None)]
    # D has only a previous row, and Z none at all: nothing shows.
    assert rows_of(summary.compare(got, "D"), *shown) == [("D", None, None, None, None)]
    assert rows_of(summary.compare(got, "Z"), *shown) == [("Z", None, None, None, None)]
