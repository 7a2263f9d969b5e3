import json
from dataclasses import replace

import pytest

from custvalue.functions.files import children
from custvalue.functions.materialise import ensure_checkpoint_dir
from custvalue.operators import overview
from custvalue.operators.periods import Period
from custvalue.operators.scoring import LinearModel
from custvalue.plans import Inputs, documents, load_reports, payload, publish, report_tables
from custvalue.plans.reports import TABLES
from custvalue.rules import Rules
from tests.conftest import rows_of

RULES = Rules(forecast_start="2021-05-01", forecast_end="2021-05-10")


@pytest.fixture(scope="module")
def inputs(spark, make_tx, make_contacts):
    tx = make_tx(
        (1, "2021-05-01", "w", "A", 10), (1, "2021-05-03", "w", "A", 20), (1, "2021-05-05", "w", "A", 30),
        (2, "2021-05-01", "w", "A", 10), (2, "2021-05-03", "w", "A", 20),
        (3, "2021-08-01", "w", "A", 50),
        (4, "2020-03-01", "w", "A", 5), (4, "2020-03-05", "w", "A", 5), (5, "2020-03-05", "w", "A", 9),
        (6, "2022-04-30", "w", "B", 7),
        (None, "2022-05-01", "w", "B", 7),
    )
    contacts = make_contacts((1, None, None, None, "25-34"), (2, None, None, None, "18-24"))
    geo = spark.createDataFrame([("A", 51.0, -1.0), ("B", 52.0, -2.0)],
                                "location string, latitude double, longitude double")
    return Inputs(tx, contacts, geo, LinearModel(0, {"value": 1}), LinearModel(100))


@pytest.fixture(scope="module")
def published(spark, inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports"))
    publish(inputs, path, RULES)
    return load_reports(spark, path)


def test_published_equal_computed(inputs, published):
    assert set(published) == set(TABLES)
    fresh = report_tables(inputs, published["clv"], published["as_of"].scalar(), RULES)
    for name, df in fresh.items():
        assert rows_of(published[name], *df.columns) == rows_of(df), name
        assert dict(published[name].dtypes) == dict(df.dtypes), name


def test_dashboard_document(published):
    row = documents.dashboard(published, "A", Period.from_params(), RULES)
    doc = json.loads(documents.as_json(row).first()[0])
    graph = doc["prediction_graph"]
    assert graph["day_of_year"] == list(range(1, 11))
    assert graph["prediction_val"] == [100.0 * n for n in range(1, 11)]
    assert graph["transaction_val"] == [20.0, 60.0, 90.0, 140.0, 147.0]
    assert graph["map_location"] == ["A"] and graph["no_new_cus"] == [2]
    assert doc["all_cus_clv"]["users"] == 5 and doc["loyal_cus_clv"]["users"] == 1
    assert doc["analytics_graph"]["age_category"] == ["18-24", "25-34"]
    assert doc["analytics_graph"]["no_cus_age_group"] == [2, 3]
    assert doc["unknown_tot_cus"] == 4
    assert doc["revenue_graph"]["day_of_day_of_week"] == [0, 2, 3, 5, 6]
    summary = doc["executive_summary"]
    assert summary["customers_selected"] == 1 and summary["new_customers_selected"] == 1
    assert summary["customers_prev"] == 1 and summary["orders_prev"] == 3
    assert set(doc) == {
        "prediction_graph", "analytics_graph", "analytics_graph_unknown", "unknown_avg_clv",
        "unknown_tot_cus", "unknown_val_of_rev", "revenue_graph", "executive_summary",
        *documents.SEGMENT_FIELDS.values(),
    }


def test_documents_of_a_place_without_data(published):
    def parsed(df):
        return json.loads(documents.as_json(df).first()[0])

    ages = parsed(documents.age_document(published["age_analytics"], "Z"))
    assert ages["analytics_graph"]["age_category"] == [] and ages["unknown_avg_clv"] is None
    weekdays = parsed(documents.weekday_document(published["weekday_revenue"], "Z"))
    assert weekdays == {"revenue_graph": {"day_of_day_of_week": [], "transaction_value": []}}
    segments = parsed(documents.segment_document(published["segments"], "Z"))
    assert segments["churn_cus_clv"] == {v: [] for v in documents.SEGMENT_VALUES}
    period = Period.from_params(year=2021)
    summary = parsed(documents.summary_document(published["first_visit"], "Z", period))
    assert set(summary["executive_summary"].values()) == {"-"} and len(summary["executive_summary"]) == 16


def test_missing_previous_period_reads_as_dashes(published):
    period = Period.from_params(year=2020)
    doc = documents.summary_document(published["first_visit"], "A", period)
    summary = json.loads(documents.as_json(doc).first()[0])["executive_summary"]
    assert summary["orders_selected"] == 3 and summary["orders_prev"] == "-"


def test_segment_and_location_documents(published):
    row = documents.segment_document(published["segments"], "A").first()
    assert row["all_cus_clv"]["users"] == [5] and row["top_cus_clv"]["users"] == [2]
    assert documents.locations_document(published["locations"]).first()[0] == ["A", "B"]


def test_payload_keeps_order_across_columns(published):
    geo = published["location_overview"].select("location", "latitude")
    both = geo.unionByName(geo.selectExpr("'0' as location", "cast(null as double) as latitude"))
    row = payload.to_payload(both, ["location"]).first()
    assert row["location"] == ["0", "A"] and row["latitude"] == [None, 51.0]


def test_locations_table_has_every_place(inputs, published):
    assert rows_of(published["locations"]) == rows_of(overview.locations(inputs.transactions))


def test_a_failed_run_changes_nothing(spark, inputs, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        load_reports(spark, path)
    publish(inputs, path, RULES)
    before = children(spark, path)
    jobs = [n for n in children(spark, ensure_checkpoint_dir(spark)) if n.startswith("job-")]
    broken = replace(inputs, geo=inputs.geo.selectExpr("location", "latitude", "raise_error('x') AS longitude"))
    with pytest.raises(Exception, match="x"):
        publish(broken, path, RULES)
    assert children(spark, path) == before and len(before) == 1
    assert [n for n in children(spark, ensure_checkpoint_dir(spark)) if n.startswith("job-")] == jobs


def test_readers_see_one_version(spark, inputs, tmp_path):
    path = str(tmp_path)
    publish(inputs, path, RULES)
    old = load_reports(spark, path)
    publish(replace(inputs, transactions=inputs.transactions.filter("ctc_id < 3")), path, RULES)
    assert old["clv"].count() == 6 and load_reports(spark, path)["clv"].count() == 2
    publish(inputs, path, RULES)
    assert len(children(spark, path)) == 2 and load_reports(spark, path)["clv"].count() == 6


def test_rules_travel_with_the_reports(spark, inputs, tmp_path):
    rules = Rules(forecast_start="2021-05-01", forecast_end="2021-05-10", unknown_age="n/a",
                  churn_factor=0.5, spender_share=0.5, default_year=2020)
    publish(inputs, str(tmp_path), rules)
    reports = load_reports(spark, str(tmp_path))
    assert reports.rules == rules
    period = Period.from_params(year=2021)
    doc = json.loads(documents.as_json(documents.dashboard(reports, "A", period)).first()[0])
    assert doc["unknown_tot_cus"] == 4 and "n/a" not in doc["analytics_graph"]["age_category"]
    given = json.loads(documents.as_json(documents.dashboard(reports, "A", period, rules)).first()[0])
    assert doc == given


def test_the_distinct_transactions_are_shuffled_once(inputs, published):
    tables = report_tables(inputs, published["clv"], published["as_of"].scalar(), RULES)
    for name in ("weekday_revenue", "age_analytics"):
        plan = tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "entries" in plan and "order_date, source, location, value" not in plan.replace("#", "")
