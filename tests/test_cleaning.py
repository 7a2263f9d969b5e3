import datetime as dt

import pytest

from custvalue.operators import cleaning
from custvalue.operators.age import visits
from custvalue.operators.cleaning import (
    ALL_COLUMNS,
    NO_SOURCE,
    NO_SOURCE_NO_LOCATION,
    distinct_rows,
    nested_distinct,
)
from custvalue.operators.features import first_visit, rfm
from custvalue.operators.overview import locations
from custvalue.operators.scoring import score_clv
from custvalue.operators.series import daily_revenue
from tests.conftest import rows_of


def test_contacts_ignore_nulls_in_dropped_columns(make_contacts):
    contacts = make_contacts(
        (1, None, None, None, "18-24"),
        (1, "AB1", 20, "2000-01-01", "18-24"),
        (2, "AB2", 30, None, None),
        (None, "AB3", 40, None, "25-34"),
        (3, None, None, None, "25-34"),
        (3, None, None, None, "35-44"),
    )
    expected = [(1, "18-24"), (3, "25-34"), (3, "35-44")]
    assert rows_of(cleaning.clean_contacts(contacts)) == expected


def test_typed_transactions_lose_the_time_of_day(spark):
    raw = spark.createDataFrame([("2022-01-02 23:59:58",), ("2022-01-03",)], "order_date string")
    days = [r[0] for r in cleaning.type_transactions(raw).orderBy("order_date").collect()]
    assert days == [dt.date(2022, 1, 2), dt.date(2022, 1, 3)]


def test_each_column_set_gives_its_own_distinct_rows(make_tx):
    tx = make_tx(
        (1, "2022-01-01", "web", "A", 5),
        (1, "2022-01-01", "web", "A", 5),
        (1, "2022-01-01", "app", "A", 5),
        (1, "2022-01-01", None, "A", 5),
        (1, "2022-01-01", "web", "B", 5),
        (2, "2022-01-01", None, "A", 7),
        (3, "2022-01-01", "web", None, 8),
        (4, "2022-01-01", "web", "A", None),
        (None, "2022-01-01", "web", "A", 1),
        (5, "2022-01-01", "web", "A", float("nan")),
    )
    assert cleaning.distinct_rows(tx, cleaning.ALL_COLUMNS).count() == 3
    assert cleaning.distinct_rows(tx, cleaning.NO_SOURCE).count() == 3
    assert cleaning.distinct_rows(tx, cleaning.NO_SOURCE_NO_LOCATION).count() == 3
    null_source = rows_of(cleaning.distinct_rows(tx, cleaning.NO_SOURCE), "ctc_id")
    assert null_source == [(1,), (1,), (2,)]
    null_place = rows_of(cleaning.distinct_rows(tx, cleaning.NO_SOURCE_NO_LOCATION), "ctc_id")
    assert null_place == [(1,), (2,), (3,)]


def test_as_of_date_comes_from_uncleaned_rows(make_tx):
    tx = make_tx((1, "2022-01-01", "web", "A", 5), (None, "2022-03-01", None, None, None))
    assert cleaning.as_of(tx).first()[0] == dt.date(2022, 3, 1)
    assert rows_of(rfm(tx), "ctc_id", "days_since_last_visit") == [(1, 59)]


def test_rfm(make_tx):
    tx = make_tx(
        (1, "2022-01-01", "web", "A", 10),
        (1, "2022-01-01", "app", "A", 10),
        (1, "2022-01-11", "web", "A", -4),
        (1, "2022-01-05", "web", "B", 7),
        (2, "2022-01-31", None, "A", 3),
    )
    columns = ["ctc_id", "location", "no_visit", "value", "customer_age", "recency",
               "days_since_last_visit"]
    features = rfm(tx)
    assert features.columns == columns
    assert rows_of(features) == [
        (1, "A", 2, 3.0, 30, 10, 20),
        (1, "B", 1, 7.0, 26, 0, 26),
        (2, "A", 1, 3.0, 0, 0, 0),
    ]
    assert features.filter("recency + days_since_last_visit != customer_age").count() == 0


def test_scored_rows_and_first_visit(make_tx, model):
    tx = make_tx((1, "2022-01-01", "w", "A", 10), (1, "2022-01-11", "w", "A", 4),
                 (1, "2022-01-21", "w", "A", 4))
    clv = score_clv(rfm(tx), model)
    assert rows_of(clv, "clv_3m", "total_transaction", "frequency") == [(10.0, 6.0, 6.667)]
    visit = first_visit(clv, cleaning.as_of_date(tx))
    got = rows_of(visit, "order_date", "month", "year", "day_of_week", "day_of_year")
    assert got == [(dt.date(2022, 1, 1), 1, 2022, 5, 1)]


def test_locations(make_tx):
    tx = make_tx((1, "2022-01-01", "w", "A", 1), (2, "2022-01-01", "w", "A", 1),
                 (2, "2022-01-01", "w", None, 1), (2, "2022-01-01", None, "B", 1))
    assert rows_of(locations(tx)) == [("A",), ("B",)]


@pytest.mark.parametrize("max_places", [1_024, 2])
def test_nested_sets_equal_single_ones(spark, make_tx, max_places):
    """Nulls, copies, hot copies, and rows that are equal in one set only."""
    rows = [
        (1, "2020-01-01", "w", "A", 5), (1, "2020-01-01", "w", "A", 5), (1, "2020-01-01", "v", "A", 5),
        (1, "2020-01-01", None, "A", 5), (1, "2020-01-01", "w", None, 5), (1, "2020-01-01", None, None, 6),
        (None, "2020-01-01", "w", "A", 5), (1, None, "w", "A", 5), (1, "2020-01-01", "w", "A", None),
        (1, "2020-01-01", "w", "B", 5), (1, "2020-01-01", "w", "B", -0.0), (1, "2020-01-01", "w", "B", 0.0),
    ] + [(9, "2021-01-01", "w", "A", 1)] * 500
    rows += [(n % 3, "2021-01-01", f"s{n % 20}", f"place {n % 11}", n % 2) for n in range(2_000)]
    tx = make_tx(*rows).repartition(7)
    nested = nested_distinct(tx, max_places)
    for columns in (ALL_COLUMNS, NO_SOURCE, NO_SOURCE_NO_LOCATION):
        assert rows_of(distinct_rows(nested, columns)) == rows_of(distinct_rows(tx, columns))
    assert rows_of(rfm(nested, "2022-01-01")) == rows_of(rfm(tx, "2022-01-01"))
    assert rows_of(daily_revenue(nested, "2019-01-01", "2022-01-01")) == rows_of(daily_revenue(tx, "2019-01-01", "2022-01-01"))
    with pytest.raises(ValueError, match="before cleaning"):
        rfm(nested)
    assert nested_distinct(tx.filter("ctc_id < 0")).rows(ALL_COLUMNS).count() == 0


@pytest.mark.parametrize("max_places", [1_024, 2])
def test_places_seen_in_one_pass(spark, make_tx, max_places):
    rows = [
        (1, "2020-01-01", "w", "A", 5), (1, "2020-01-01", "v", "A", 5), (1, "2020-01-01", "w", "B", 5),
        (1, "2020-01-01", None, "A", 5), (1, "2020-01-01", "w", None, 5), (1, "2020-01-01", None, None, 6),
        (None, "2029-01-01", "x", "closed", 5), (1, None, "w", "A", 5), (1, "2020-01-01", "y", "B", None),
        (2, "2020-01-01", "w", "A", float("nan")), (2, "2020-01-01", "z", "C", float("nan")),
    ] + [(n % 3, "2021-01-01", f"s{n % 4}", f"place {n % 3}", n % 2) for n in range(200)]
    tx = make_tx(*rows).repartition(5)
    seen = cleaning.seen_places(tx).cache()
    assert rows_of(cleaning.as_of(seen)) == rows_of(cleaning.as_of(tx))
    assert rows_of(locations(seen)) == rows_of(locations(tx))
    nested = nested_distinct(tx, max_places, seen)
    assert nested.known == nested_distinct(tx, max_places).known
    assert (nested.known is None) == (max_places == 2)
    for columns in (ALL_COLUMNS, NO_SOURCE, NO_SOURCE_NO_LOCATION):
        assert rows_of(nested.rows(columns)) == rows_of(distinct_rows(tx, columns))
        assert rows_of(nested.named().rows(columns)) == rows_of(distinct_rows(tx, columns))
    assert rows_of(visits(nested)) == rows_of(visits(tx))
    assert rows_of(rfm(nested, "2022-01-01")) == rows_of(rfm(tx, "2022-01-01"))


def test_one_exchange_for_all_three_sets(spark, make_tx):
    nested = nested_distinct(make_tx((1, "2020-01-01", "w", "A", 5)))
    plan = nested.table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ctc_id") == 1 and plan.count("Exchange hash") == 1
    assert "partial_bit_or" in plan and "SortMergeJoin" not in plan
    stored = nested.stored()
    for columns in (ALL_COLUMNS, NO_SOURCE, NO_SOURCE_NO_LOCATION):
        assert "Exchange" not in stored.rows(columns)._jdf.queryExecution().executedPlan().toString()
