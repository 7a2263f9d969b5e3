from custvalue.operators import overview
from custvalue.rules import Rules
from custvalue.sources import venue_coordinates, venue_names
from custvalue.sources.venues import DEFAULT_LOCATION
from tests.conftest import rows_of


def sample(make_clv):
    return make_clv(
        {"ctc_id": 1, "location": "A", "no_visit": 1, "value": 1.0, "clv_3m": 2},
        {"ctc_id": 2, "location": "A", "no_visit": 2, "value": 2.0, "clv_3m": 4},
        {"ctc_id": 3, "location": "A", "no_visit": 3, "value": 6.0, "clv_3m": 9},
        {"ctc_id": 4, "location": "B", "no_visit": 3, "value": 5.0, "clv_3m": 5},
    )


def test_groups(make_clv):
    clv = sample(make_clv)
    assert rows_of(overview.overview(clv, "all")) == [("A", 5.0, 3.0, 9.0, 3), ("B", 5.0, 5.0, 5.0, 1)]
    assert rows_of(overview.overview(clv, "loyal"))[0] == ("A", 9.0, 6.0, 6.0, 1)
    assert rows_of(overview.overview(clv, "new")) == [("A", 2.0, 1.0, 1.0, 1)]
    assert rows_of(overview.overview(clv, "repeat"))[0] == ("A", 6.5, 4.0, 8.0, 2)


def test_location_without_new_customers_is_left_out(make_clv):
    clv = sample(make_clv)
    wide = overview.location_overview(clv)
    assert rows_of(wide, "location", "total_customer", "no_loyal_cus", "loyal_cus_percent") == [
        ("A", 3, 1, 33.300000000000004)
    ]
    joined = overview.overview(clv, "all")
    for group in ("loyal", "new", "repeat"):
        joined = joined.join(overview.overview(clv, group), "location")
    assert rows_of(wide, *joined.columns) == rows_of(joined)


def test_loyalty_threshold_is_a_rule(make_clv):
    wide = overview.location_overview(sample(make_clv), Rules(loyal_visits=2))
    assert rows_of(wide, "location", "no_loyal_cus") == [("A", 2)]


def test_geo_drops_unknown_places(spark, make_clv):
    geo = spark.createDataFrame([("A", 51.47063, -2.24375), ("Z", 1.0, 1.0)],
                                "location string, latitude double, longitude double")
    placed = overview.with_geo(overview.overview(sample(make_clv)), geo)
    assert rows_of(placed, "location", "latitude", "longitude") == [("A", 51.471, -2.244)]


def test_known_venues(spark):
    assert venue_coordinates(spark).count() == 39
    assert venue_names(spark).distinct().count() == 39
    assert venue_names(spark).filter(f"location = '{DEFAULT_LOCATION}'").count() == 1
