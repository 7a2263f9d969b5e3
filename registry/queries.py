"""One query per report operator, over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.dates import calendar, with_calendar
from custvalue.functions.materialise import ensure_checkpoint_dir, materialise
from custvalue.functions.rounding import half_even
from custvalue.operators import (
    age,
    cleaning,
    features,
    overview,
    period_table,
    periods,
    scoring,
    segments,
    series,
    spenders,
    summary,
    training,
    weekday,
)
from custvalue.operators.periods import Period
from custvalue.plans import documents, increments, payload, report_tables, reports, scored_clv
from custvalue.sources import read_contacts, read_json, read_transactions, write_json
from registry import fixtures as fx
from registry.fixtures import RULES, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR = Period.from_params(year=1997)
MONTH = Period.from_params(year=1997, month=1)
RANGE = Period.from_params(start="1997-03-01", end="1997-08-31")
OPEN_RANGE = Period.from_params(start="2000-01-01")
KINDS = {"year": YEAR, "month": MONTH, "range": RANGE, "open": OPEN_RANGE, "everything": Period()}


# Means of values with few decimals often fall on a rounding tie, where the last bit of a sum
# would decide. Shifted by this much, ties round one way.
OFF_TIE = 1.37e-8


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six decimals: the last bits of a sum depend on row order."""
    return df.select(
        *[
            half_even(F.col(f.name) + F.lit(OFF_TIE), 6).alias(f.name)
            if f.dataType.typeName() == "double"
            else f.name
            for f in df.schema.fields
        ]
    )


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register ``build`` under its own name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: tidy(build(Tables(spark, sf_dir)))
    return build


def line_clv(t: Tables) -> DataFrame:
    return scored_clv(fx.line_inputs(t))


def order_clv(t: Tables) -> DataFrame:
    return scored_clv(fx.order_inputs(t))


def clean_contacts(t: Tables) -> DataFrame:
    return cleaning.clean_contacts(fx.contacts(t))


def line_first_visits(t: Tables) -> DataFrame:
    tx = fx.line_visits(t)
    return features.first_visit(line_clv(t), cleaning.as_of_date(tx))


def data_span(t: Tables) -> tuple[Column, Column]:
    """From the first day of the data to 30 days past its last."""
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day"))
    first = days.agg(F.min("day")).scalar()
    last = days.agg(F.date_add(F.max("day"), 30)).scalar()
    return first, last


def actual(t: Tables) -> DataFrame:
    return series.daily_revenue(fx.line_visits(t), RULES.actuals_start, RULES.actuals_end)


def forecast_for_rules(t: Tables) -> DataFrame:
    return series.forecast(t.spark, RULES.forecast_start, RULES.forecast_end, fx.FORECAST_MODEL)


# Inputs


@query
def contacts_clean(t):
    return clean_contacts(t)


@query
def transactions_typed(t):
    return cleaning.type_transactions(fx.raw_line_visits(t).drop("l_linenumber"))


@query
def transactions_from_csv(t):
    return read_transactions(t.spark, fx.csv_transactions(t))


@query
def contacts_from_csv(t):
    return read_contacts(t.spark, fx.csv_contacts(t))


@query
def as_of_date(t):
    return cleaning.as_of(fx.line_visits(t))


@query
def tx_distinct_full(t):
    return cleaning.distinct_rows(fx.line_visits_with_copies(t), cleaning.ALL_COLUMNS)


@query
def tx_distinct_loc(t):
    return cleaning.distinct_rows(fx.line_visits_with_copies(t), cleaning.NO_SOURCE)


@query
def tx_distinct_daily(t):
    return cleaning.distinct_rows(fx.line_visits_with_copies(t), cleaning.NO_SOURCE_NO_LOCATION)


@query
def tx_distinct_nested(t):
    """The three distinct sets from one table that took one shuffle."""
    stored = cleaning.nested_distinct(fx.line_visits_with_copies(t)).stored()
    sets = {"full": cleaning.ALL_COLUMNS, "loc": cleaning.NO_SOURCE, "daily": cleaning.NO_SOURCE_NO_LOCATION}
    named = [stored.rows(columns).withColumn("name", F.lit(name)) for name, columns in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


# Daily series and forecast


@query
def daily_revenue(t):
    return actual(t)


@query
def calendar_features(t):
    days = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return with_calendar(days, "order_date")


@query
def forecast_calendar(t):
    return calendar(t.spark, *data_span(t))


@query
def forecast_scored(t):
    return series.forecast(t.spark, *data_span(t), fx.FORECAST_MODEL)


@query
def actual_forecast_union(t):
    return series.actual_and_forecast(actual(t), forecast_for_rules(t))


@query
def cumulative_revenue(t):
    return series.cumulative(actual(t), "value")


@query
def cumulative_forecast(t):
    return series.cumulative(
        series.forecast(t.spark, *data_span(t), fx.FORECAST_MODEL), "label"
    )


@query
def cumulative_self_join(t):
    return series.cumulative_pairs(series.cumulative(actual(t), "value"), "value")


@query
def forecast_report(t):
    return series.forecast_report(
        series.cumulative(actual(t), "value"), series.cumulative(forecast_for_rules(t), "label")
    )


# Features and scores


@query
def rfm_features(t):
    return features.rfm(fx.line_visits(t))


def two_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The transactions before 1997, and the later ones with some that the first part has already."""
    tx = materialise(fx.line_visits(t))
    late = F.col("order_date") >= F.lit("1997-01-01").cast("date")
    return tx.filter(~late), tx.filter(late | (F.col("ctc_id") % 5 == 0))


@query
def rfm_in_two_parts(t):
    """Visit features from a state that was updated twice."""
    state = f"{ensure_checkpoint_dir(t.spark)}/state-{uuid.uuid4().hex}"
    for part in two_parts(t):
        increments.update_state(t.spark, state, part, buckets=16)
    return increments.state_features(t.spark, state)


@query
def clv_scored(t):
    return line_clv(t)


# Overview


@query
def overview_all(t):
    return overview.overview(line_clv(t), "all")


@query
def overview_loyal(t):
    return overview.overview(line_clv(t), "loyal")


@query
def overview_new(t):
    return overview.overview(line_clv(t), "new")


@query
def overview_repeat(t):
    return overview.overview(line_clv(t), "repeat")


@query
def location_overview(t):
    return overview.location_overview(line_clv(t))


@query
def location_overview_orders(t):
    return overview.location_overview(order_clv(t))


@query
def location_geo(t):
    return overview.with_geo(overview.location_overview(line_clv(t)), fx.geo(t))


@query
def locations(t):
    return overview.locations(fx.line_visits(t))


# Age categories


@query
def visits(t):
    return age.visits(fx.line_visits_with_copies(t)).drop("entries")


@query
def visits_with_age(t):
    return age.with_age(age.visits(fx.line_visits(t)).drop("entries"), clean_contacts(t))


@query
def age_revenue(t):
    return age.age_revenue(age.visits(fx.line_visits(t)), clean_contacts(t))


@query
def age_revenue_share(t):
    return age.age_share(age.age_revenue(age.visits(fx.line_visits(t)), clean_contacts(t)))


@query
def age_clv_stats(t):
    return age.age_clv(line_clv(t), clean_contacts(t))


@query
def age_analytics(t):
    return age.age_analytics(age.visits(fx.line_visits(t)), line_clv(t), clean_contacts(t))


@query
def age_for_location(t):
    analytics = age.age_analytics(age.visits(fx.line_visits(t)), line_clv(t), clean_contacts(t))
    return age.age_for_location(analytics, fx.PLACE)


# Weekdays


@query
def daily_location_revenue(t):
    return weekday.daily_location(age.visits(fx.line_visits(t)))


@query
def weekday_revenue(t):
    return weekday.weekday_revenue(age.visits(fx.line_visits(t)))


@query
def weekday_for_location(t):
    return weekday.weekday_for_location(
        weekday.weekday_revenue(age.visits(fx.line_visits(t))), fx.PLACE
    )


# Segments


@query
def segment_all(t):
    return segments.segment(line_clv(t), "all")


@query
def segment_loyal(t):
    return segments.segment(line_clv(t), "loyal")


@query
def segment_repeat(t):
    return segments.segment(line_clv(t), "repeat")


@query
def top_customers(t):
    return spenders.spenders(order_clv(t), "top")


@query
def segment_top(t):
    return segments.segment(order_clv(t), "top")


@query
def low_customers(t):
    return spenders.spenders(order_clv(t), "low")


@query
def segment_low(t):
    return segments.segment(order_clv(t), "low")


@query
def segment_risk(t):
    return segments.segment(line_clv(t), "risk")


@query
def churn_threshold(t):
    return segments.churn_frequency(line_clv(t))


@query
def segment_churn(t):
    return segments.segment(materialise(line_clv(t)), "churn")


@query
def segments_long(t):
    return segments.segments(materialise(line_clv(t)))


@query
def segments_long_orders(t):
    return segments.segments(materialise(order_clv(t)))


@query
def segments_for_location(t):
    rows = segments.segments(materialise(order_clv(t)))
    return segments.segments_for_location(rows, fx.PLACE)


# Periods and summaries


@query
def first_visit(t):
    return line_first_visits(t)


def both_periods(t: Tables, period: Period) -> DataFrame:
    rows = line_first_visits(t)
    windows = [
        periods.select_period(rows, period, which).withColumn("which", F.lit(which))
        for which in (periods.CURRENT, periods.PREVIOUS)
    ]
    columns = ["which", "ctc_id", "location", "order_date", "clv_3m"]
    return reduce(DataFrame.unionByName, windows).select(*columns)


@query
def period_year(t):
    return both_periods(t, YEAR)


@query
def period_month(t):
    return both_periods(t, MONTH)


@query
def period_range(t):
    return both_periods(t, RANGE)


@query
def period_open_range(t):
    return both_periods(t, OPEN_RANGE)


@query
def period_tagged(t):
    tagged = periods.tag_periods(line_first_visits(t), OPEN_RANGE)
    return tagged.select("period", "ctc_id", "location", "order_date", "clv_3m")


def tagged_year(t: Tables) -> DataFrame:
    return periods.tag_periods(line_first_visits(t), YEAR)


def stored_tagged(t: Tables, period: Period) -> DataFrame:
    """Tagged rows of stored first visits: the churn threshold takes a pass of its own."""
    return periods.tag_periods(materialise(line_first_visits(t)), period)


@query
def summary_all(t):
    return summary.summary_part(tagged_year(t), "all")


@query
def summary_repeat(t):
    return summary.summary_part(tagged_year(t), "repeat")


@query
def summary_new(t):
    return summary.summary_part(tagged_year(t), "new")


@query
def summary_churn(t):
    return summary.summary_part(stored_tagged(t, YEAR), "churn")


@query
def executive_summary(t):
    return summary.executive_summary(stored_tagged(t, YEAR))


@query
def executive_summary_range(t):
    return summary.executive_summary(stored_tagged(t, RANGE))


@query
def summary_compare(t):
    return summary.compare(summary.executive_summary(stored_tagged(t, YEAR)))


@query
def summary_compare_location(t):
    return summary.compare(summary.executive_summary(stored_tagged(t, YEAR)), fx.PLACE)


def stored_period_tables(t: Tables) -> period_table.PeriodTables:
    tables = period_table.period_tables(line_first_visits(t), RULES)
    return period_table.PeriodTables(*[materialise(table) for table in tables])


@query
def executive_summary_periods(t):
    """Every kind of period from the nodes of days, without a customer's row."""
    tables = stored_period_tables(t)
    each = [
        period_table.summary_of_period(tables, period, RULES).withColumn("kind", F.lit(kind))
        for kind, period in KINDS.items()
    ]
    return reduce(DataFrame.unionByName, each)


@query
def summary_compare_periods(t):
    return summary.compare(period_table.summary_of_period(stored_period_tables(t), YEAR, RULES))


# Payloads, publishing and the combined report


def text_of(value: Column, kind: T.DataType) -> Column:
    """A leaf of a document as text; numbers with fractions to six decimals."""
    if isinstance(kind, T.VariantType):
        number = text_of(F.try_variant_get(value, "$", "double"), T.DoubleType())
        return F.coalesce(number, F.lit(documents.MISSING))
    if isinstance(kind, T.DoubleType):
        value = half_even(value + F.lit(OFF_TIE), 6).cast("decimal(28,6)")
    return value.cast("string")


def leaves(value: Column, kind: T.DataType, path: str) -> list[Column]:
    """Arrays of (field, place, value) for everything below ``path``; place -1 is a single value."""
    if isinstance(kind, T.StructType):
        return [
            leaf
            for f in kind.fields
            for leaf in leaves(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)
        ]

    def row(place: Column, text: Column) -> Column:
        return F.struct(
            F.lit(path).alias("field"), place.cast("long").alias("place"), text.alias("value")
        )

    if isinstance(kind, T.ArrayType):
        return [F.transform(value, lambda x, i: row(i, text_of(x, kind.elementType)))]
    return [F.array(row(F.lit(-1), text_of(value, kind)))]


def flat(document: DataFrame) -> DataFrame:
    """Every value of a one-row document as a row of its own."""
    whole = document.select(F.struct("*").alias("whole"))
    parts = leaves(F.col("whole"), whole.schema["whole"].dataType, "")
    return whole.select(F.explode(F.concat(*parts)).alias("leaf")).select("leaf.*")


@query
def report_payload(t):
    report = overview.with_geo(overview.location_overview(line_clv(t)), fx.geo(t))
    return flat(payload.to_payload(report, ["location"], documents.MAP_FIELDS))


@query
def publish(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/published-{uuid.uuid4().hex}"
    inputs = fx.line_inputs(t)
    inputs = replace(inputs, transactions=materialise(inputs.transactions))  # the lines are joined once
    tables = reports.publish(inputs, path, RULES)
    return reduce(DataFrame.unionByName, [totals(name, df) for name, df in tables.items()])


@query
def publish_in_two_parts(t):
    """All report tables after a publish of the first transactions and an update by the later ones."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/two-parts-{uuid.uuid4().hex}"
    inputs = fx.line_inputs(t)
    for part in two_parts(t):
        tables = reports.publish(replace(inputs, transactions=part), f"{folder}/reports", RULES, state=f"{folder}/state")
    return reduce(DataFrame.unionByName, [totals(name, df) for name, df in tables.items()])


def totals(name: str, df: DataFrame) -> DataFrame:
    """Rows of a table and the sum of each number in it (in decimals, so order does not matter)."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    sums = [F.sum(F.col(n).cast("decimal(28,6)")).cast("double").alias(n) for n in numbers]
    summed = tidy(df).agg(F.count(F.lit(1)).alias("table_rows"), *sums)
    named = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("total")) for n in numbers]
    none = F.struct(F.lit("").alias("column_name"), F.lit(None).cast("double").alias("total"))
    each = summed.select("table_rows", F.explode(F.array(*named, none)).alias("sum"))
    return each.select(F.lit(name).alias("table_name"), "table_rows", "sum.*")


@query
def dashboard(t):
    inputs = fx.line_inputs(t)
    today = cleaning.as_of_date(inputs.transactions)
    nested = reports.stored_visits(inputs)
    clv = materialise(scored_clv(inputs, today, nested))
    tables = report_tables(inputs, clv, today, RULES, nested)
    # Each leaf of the document repeats what it is made of, so it is stored before it is taken apart.
    return flat(materialise(documents.dashboard(tables, fx.PLACE, YEAR)))


@query
def document_ages(t):
    analytics = age.age_analytics(age.visits(fx.line_visits(t)), line_clv(t), clean_contacts(t))
    return flat(documents.age_document(analytics, fx.PLACE))


@query
def document_weekdays(t):
    rows = weekday.weekday_revenue(age.visits(fx.line_visits(t)))
    return flat(documents.weekday_document(rows, fx.PLACE))


@query
def document_segments(t):
    return flat(documents.segment_document(segments.segments(materialise(order_clv(t))), fx.PLACE))


@query
def document_summary(t):
    return flat(documents.summary_document(materialise(line_first_visits(t)), fx.PLACE, YEAR))


@query
def document_summary_periods(t):
    return flat(documents.period_document(stored_period_tables(t), fx.PLACE, YEAR, RULES))


@query
def document_locations(t):
    return flat(documents.locations_document(overview.locations(fx.line_visits(t))))


@query
def document_json_roundtrip(t):
    """The summary's document written as JSON and read back, field by field."""
    document = documents.period_document(stored_period_tables(t), fx.PLACE, YEAR, RULES)
    path = f"{ensure_checkpoint_dir(t.spark)}/document-{uuid.uuid4().hex}"
    write_json(document, path)
    return flat(read_json(t.spark, path, document))


@query
def locations_json_roundtrip(t):
    """A document of arrays read back without its schema, as one variant."""
    path = f"{ensure_checkpoint_dir(t.spark)}/document-{uuid.uuid4().hex}"
    write_json(documents.locations_document(overview.locations(fx.line_visits(t))), path)
    listed = F.variant_get("document", "$.locations", "array<string>")
    return read_json(t.spark, path).select(F.posexplode(listed).alias("place", "location"))


# Stored models


def stored_model(t: Tables, model: scoring.Model) -> scoring.Model:
    path = f"{ensure_checkpoint_dir(t.spark)}/model-{uuid.uuid4().hex}"
    training.save_model(t.spark, model, path)
    return training.load_model(t.spark, path)


@query
def model_load_scored(t):
    """Values by a linear formula that was stored and loaded."""
    return scoring.score_clv(features.rfm(fx.line_visits(t)), stored_model(t, fx.CLV_MODEL))


@query
def clv_trees_scored(t):
    """Values by boosted trees with the location encoded, stored, loaded and scored as one expression."""
    return scoring.score_clv(features.rfm(fx.line_visits(t)), stored_model(t, fx.TREE_MODEL))


# Model fitting


def training_set(t: Tables) -> DataFrame:
    tx = fx.line_visits(t)
    return training.clv_training_set(tx, F.date_sub(cleaning.as_of_date(tx), 90))


@query
def clv_training_set(t):
    return training_set(t)


def coarse(df: DataFrame, label: str, digits: int) -> DataFrame:
    """Predictions in fewer digits: two solvers agree in many, but not in the last."""
    return df.withColumn(label, half_even(F.col(label) + F.lit(OFF_TIE), digits))


@query
def clv_model_fit(t):
    """A value model fitted on the past by least squares, scoring today's features."""
    model = training.fit_clv_model(
        materialise(training_set(t)),
        LinearRegression(solver="normal"),
        training.LINEAR_CLV_FEATURES,
        with_location=False,
    )
    scored = scoring.score_clv(features.rfm(fx.line_visits(t)), model)
    return coarse(scored.select("ctc_id", "location", "clv_3m"), "clv_3m", 1)


@query
def forecast_model_fit(t):
    """A forecast fitted on all daily revenue by least squares, scoring the data's span."""
    first, last = data_span(t)
    daily = materialise(series.daily_revenue(fx.line_visits(t), first, last))
    model = training.fit_forecast_model(daily, LinearRegression(solver="normal"))
    return coarse(series.forecast(t.spark, first, last, model), "label", 0)
