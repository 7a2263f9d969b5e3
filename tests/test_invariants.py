"""What must hold between reports, on the test tables."""

import pytest
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.operators import age, overview, segments, series
from registry import queries
from registry.fixtures import RULES, Tables, line_visits
from tests.test_queries import SF_DIR


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def clv(tables):
    return materialise(queries.line_clv(tables))


def test_new_and_repeat_customers_are_all(clv):
    groups = {g: overview.overview(clv, g) for g in overview.GROUPS}
    total = groups["all"].agg(F.sum("total_customer")).first()[0]
    new = groups["new"].agg(F.sum("no_new_cus")).first()[0]
    repeat = groups["repeat"].agg(F.sum("no_repeat_cus")).first()[0]
    loyal = groups["loyal"].agg(F.sum("no_loyal_cus")).first()[0]
    assert new + repeat == total == clv.count() and loyal <= repeat


def test_recency_and_idle_days_make_the_age(clv):
    assert clv.filter("recency + days_since_last_visit != customer_age").count() == 0
    assert clv.filter("no_visit = 1 and recency != 0").count() == 0


def test_last_running_total_is_the_sum(tables):
    daily = series.daily_revenue(line_visits(tables), RULES.actuals_start, RULES.actuals_end)
    totals = series.cumulative(daily, "value")
    last = totals.orderBy(F.desc("days")).first()
    assert last["value"] == daily.agg(F.sum("value")).first()[0]
    assert last["days"] == daily.count()


def test_shares_of_a_location_make_a_whole(tables):
    revenue = age.age_revenue(age.visits(line_visits(tables)), queries.clean_contacts(tables))
    whole = age.age_share(revenue).groupBy("location").agg(F.sum("age_cat_revenue_per").alias("s"))
    assert whole.filter("abs(s - 100) > 0.5").count() == 0


def test_overview_and_segments_agree(clv):
    wide = overview.location_overview(clv)
    every = segments.segments(clv).filter("segment = 'all'").select("location", "users", "revenue")
    joined = wide.join(every, "location")
    assert joined.count() == wide.count() > 0
    assert joined.filter("users != total_customer or revenue != total_transaction").count() == 0
