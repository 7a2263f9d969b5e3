import math

import pytest
from pyspark.sql import functions as F

from custvalue.operators import age, cleaning, weekday
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def tx(make_tx):
    return make_tx(
        (1, "2022-01-03", "w", "A", 10),
        (1, "2022-01-03", "w", "A", 20),
        (1, "2022-01-03", "w", "A", 20),
        (1, "2022-01-03", "app", "A", 5),
        (1, "2022-01-10", "w", "A", 6),
        (2, "2022-01-04", "w", "A", -1),
        (3, "2022-01-04", "w", "A", 40),
        (3, "2022-01-04", "w", "B", 7),
        (4, "2022-01-04", None, "A", 99),
    )


@pytest.fixture(scope="module")
def contacts(make_contacts):
    return cleaning.clean_contacts(make_contacts(
        (1, None, None, None, "18-24"),
        (2, None, None, None, "25-34"),
        (2, None, None, None, "35-44"),
        (3, None, None, None, None),
    ))


def test_visits_add_up_per_day_and_source(tx):
    got = rows_of(age.visits(tx), "ctc_id", "location", "source", "value")
    assert got == [
        (1, "A", "app", 5.0), (1, "A", "w", 30.0), (1, "A", "w", 6.0), (2, "A", "w", -1.0),
        (3, "A", "w", 40.0), (3, "B", "w", 7.0),
    ]


def test_second_age_category_multiplies_rows(tx, contacts):
    aged = age.with_age(age.visits(tx), contacts)
    got = rows_of(aged.filter("ctc_id > 1"), "ctc_id", "location", "age_category")
    assert got == [(2, "A", "25-34"), (2, "A", "35-44"), (3, "A", "Unknown"), (3, "B", "Unknown")]


def test_revenue_and_share(tx, contacts):
    shares = age.age_share(age.age_revenue(age.visits(tx), contacts))
    got = rows_of(shares, "location", "age_category", "total_cus", "age_cat_total_transaction",
                  "age_cat_revenue_per")
    # Location A: 41 + 40 - 1 - 1 = 79, customer 2 counted under both categories.
    assert got == [
        ("A", "18-24", 3, 41.0, 51.9),
        ("A", "25-34", 1, -1.0, -1.3),
        ("A", "35-44", 1, -1.0, -1.3),
        ("A", "Unknown", 1, 40.0, 50.6),
        ("B", "Unknown", 1, 7.0, 100.0),
    ]


def test_share_of_a_zero_total_is_null(spark):
    revenue = spark.createDataFrame([("x", "A", 1.0), ("y", "A", -1.0)],
                                    "age_category string, location string, age_cat_total_transaction double")
    assert rows_of(age.age_share(revenue), "age_cat_revenue_per") == [(None,), (None,)]


def test_folding_before_the_join_changes_nothing(tx, contacts):
    plain = age.with_age(age.visits(tx), contacts).groupBy("age_category", "location").agg(
        F.count(F.lit(1)), F.sum("value")
    )
    folded = age.age_revenue(age.visits(tx), contacts)
    assert rows_of(folded, "age_category", "location", "total_cus", "age_cat_total_transaction") == rows_of(plain)


def test_value_statistics(make_clv, contacts):
    clv = make_clv(*[
        {"ctc_id": c, "location": p, "clv_3m": v}
        for c, p, v in [(1, "A", 1), (5, "A", 10), (6, "A", 20), (7, "A", 60), (8, "A", 70), (9, "B", 3)]
    ])
    stats = age.age_clv(clv, contacts)
    got = rows_of(stats, "location", "age_category", "total_clv_cus", "clv_3m", "avg_clv_3m",
                  "median_clv_3m", "min_clv_3m", "max_clv_3m")
    assert got == [
        ("A", "18-24", 1, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("A", "Unknown", 4, 160.0, 40.0, 40.0, 10.0, 70.0),
        ("B", "Unknown", 1, 3.0, 3.0, 3.0, 3.0, 3.0),
    ]
    deviation = {(r.location, r.age_category): r.std_clv_3m for r in stats.collect()}
    assert deviation[("B", "Unknown")] is None
    assert math.isclose(deviation[("A", "Unknown")], math.sqrt(2600 / 3))


def test_one_location(tx, contacts, make_clv):
    clv = make_clv(*[{"ctc_id": c, "location": "A", "clv_3m": c} for c in (1, 2, 3)])
    analytics = age.age_analytics(age.visits(tx), clv, contacts)
    got = rows_of(age.age_for_location(analytics, "A"), "age_category", "is_unknown", "avg_clv_3m")
    assert got == [("18-24", False, 1.0), ("25-34", False, 2.0), ("35-44", False, 2.0),
                   ("Unknown", True, 3.0)]
    # B has revenue but no scored customer.
    assert age.age_for_location(analytics, "B").count() == 0


def test_weekdays_average_rounded_daily_means(make_tx):
    tx = make_tx(
        (1, "2022-01-03", "w", "A", 1), (2, "2022-01-03", "w", "A", 1), (3, "2022-01-03", "w", "A", 2),
        (1, "2022-01-10", "w", "A", 3), (1, "2022-01-09", "w", "A", 8), (9, "2022-01-10", None, "A", 8),
    )
    daily = weekday.daily_location(age.visits(tx))
    assert daily.columns == ["location", "total_cus", "value", "month", "year", "day_of_week", "day_of_year"]
    assert rows_of(daily, "total_cus", "value", "day_of_week") == [(1, 3.0, 0), (1, 8.0, 6), (3, 1.333, 0)]
    per_weekday = weekday.weekday_revenue(age.visits(tx))
    assert rows_of(per_weekday) == [(0, "A", 4, 2.1665), (6, "A", 1, 8.0)]
    in_order = weekday.weekday_for_location(per_weekday, "A").collect()
    assert [r.day_of_week for r in in_order] == [0, 6]
    assert weekday.weekday_for_location(per_weekday, "Z").count() == 0
