from custvalue.operators import series
from custvalue.operators.scoring import LinearModel
from tests.conftest import rows_of

MODEL = LinearModel(100, {"day_of_year": 0.5})


def test_daily_revenue_keeps_positive_values_in_the_window(make_tx):
    tx = make_tx(
        (1, "2021-04-30", "w", "A", 9),
        (1, "2021-05-01", "w", "A", 2),
        (1, "2021-05-01", "app", "B", 2),
        (2, "2021-05-01", "w", "A", 3),
        (2, "2021-05-01", "w", "A", -3),
        (2, "2021-05-02", None, None, 0),
        (2, "2021-05-03", None, None, 4),
        (2, "2021-05-04", "w", "A", 9),
    )
    daily = series.daily_revenue(tx, "2021-05-01", "2021-05-03")
    assert daily.columns == ["value", "month", "year", "day_of_week", "day_of_year"]
    # The two customer-1 rows of 1 May collapse once source and location are dropped.
    assert rows_of(daily) == [(4.0, 5, 2021, 0, 123), (5.0, 5, 2021, 5, 121)]


def test_cumulative_runs_across_the_year_end(make_tx):
    tx = make_tx((1, "2022-01-02", "w", "A", 3), (1, "2021-12-31", "w", "A", 2.005),
                 (1, "2022-01-01", "w", "A", 1))
    totals = series.cumulative(series.daily_revenue(tx, "2021-01-01", "2022-12-31"), "value")
    assert rows_of(totals) == [(1, 2021, 365, 2.0), (2, 2022, 1, 3.0), (3, 2022, 2, 6.0)]
    pairs = series.cumulative_pairs(totals, "value")
    assert pairs.columns == ["days", "days_x", "year", "day_of_year", "value_x", "days_y", "value_y"]
    assert rows_of(pairs)[1] == (2, 2, 2022, 1, 3.0, 2, 3.0)


def test_forecast_report_keeps_both_lengths(spark, make_tx):
    tx = make_tx((1, "2021-05-01", "w", "A", 5), (1, "2021-05-03", "w", "A", 6))
    actual = series.daily_revenue(tx, "2021-05-01", "2021-05-03")
    predicted = series.forecast(spark, "2021-05-01", "2021-05-04", MODEL)
    union = series.actual_and_forecast(actual, predicted)
    assert union.count() == 6 and union.filter("label is null").count() == 2
    report = series.forecast_report(
        series.cumulative(actual, "value"), series.cumulative(predicted, "label")
    )
    assert rows_of(report) == [
        (1, 160.5, 5.0), (2, 321.5, 11.0), (3, 483.0, None), (4, 645.0, None),
    ]
    longer = series.forecast_report(
        series.cumulative(actual, "value"),
        series.cumulative(predicted.filter("day_of_year = 121"), "label"),
    )
    assert rows_of(longer) == [(1, 160.5, 5.0), (2, None, 11.0)]
