"""Jobs for ``spark-submit``: fit the models, publish the reports, show one as JSON.

    python -m custvalue fit --transactions tx.csv --clv-model m/clv --forecast-model m/forecast
    python -m custvalue publish --transactions tx.csv --contacts contacts.csv \
        --clv-model m/clv --forecast-model m/forecast --out reports
    python -m custvalue show summary --reports reports --location "The Sun Inn" --year 2022
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise, scratch
from custvalue.operators import cleaning, series, training
from custvalue.operators.period_table import PeriodTables
from custvalue.operators.periods import Period
from custvalue.plans import Inputs, Reports, documents, load_reports, publish
from custvalue.rules import Rules
from custvalue.session import session
from custvalue.sources import read_contacts, read_geo, read_transactions, venue_coordinates
from custvalue.sources.venues import DEFAULT_LOCATION

DOCUMENTS = ("dashboard", "ages", "weekdays", "segments", "summary", "locations")
HORIZON_DAYS = 90


def fit(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fit both models on the transactions and store them."""
    with scratch(spark):
        tx = read_transactions(spark, args.transactions, args.format)
        if args.format == "csv":
            tx = materialise(tx)  # parse the text once
        cutoff = F.date_sub(cleaning.as_of_date(tx), HORIZON_DAYS)
        rows = materialise(training.clv_training_set(tx, cutoff, HORIZON_DAYS))
        training.save_model(spark, training.fit_clv_model(rows), args.clv_model)
        daily = materialise(series.daily_revenue(tx, args.actuals_start, args.actuals_end))
        training.save_model(spark, training.fit_forecast_model(daily), args.forecast_model)


def publish_reports(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write every report table."""
    inputs = Inputs(
        read_transactions(spark, args.transactions, args.format),
        read_contacts(spark, args.contacts, args.format),
        read_geo(spark, args.geo, args.format) if args.geo else venue_coordinates(spark),
        training.load_model(spark, args.clv_model),
        training.load_model(spark, args.forecast_model),
    )
    publish(inputs, args.out, rules_of(args), with_transactions=args.format == "csv")


def show(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print one document of one location."""
    print(documents.as_json(document(load_reports(spark, args.reports), args)).first()[0])


def document(tables: Reports, args: argparse.Namespace) -> DataFrame:
    """The document asked for, by the rules the tables were published with."""
    rules = tables.rules
    period = Period.from_params(args.year, args.month, args.start, args.end, rules=rules)
    return {
        "dashboard": lambda: documents.dashboard(tables, args.location, period),
        "ages": lambda: documents.age_document(tables["age_analytics"], args.location, rules),
        "weekdays": lambda: documents.weekday_document(tables["weekday_revenue"], args.location),
        "segments": lambda: documents.segment_document(tables["segments"], args.location),
        "summary": lambda: documents.period_document(
            PeriodTables(tables["period_totals"], tables["period_idle"]), args.location, period, rules
        ),
        "locations": lambda: documents.locations_document(tables["locations"]),
    }[args.document]()


def rules_of(args: argparse.Namespace) -> Rules:
    return Rules(**{field.name: getattr(args, field.name) for field in fields(Rules)})


def parser() -> argparse.ArgumentParser:
    defaults = Rules()
    rules = argparse.ArgumentParser(add_help=False)
    for field in fields(Rules):
        value = getattr(defaults, field.name)
        rules.add_argument(f"--{field.name.replace('_', '-')}", default=value, type=type(value))
    source = argparse.ArgumentParser(add_help=False)
    source.add_argument("--transactions", required=True)
    source.add_argument("--format", default="csv", help="csv, parquet, orc, ...")
    source.add_argument("--clv-model", required=True)
    source.add_argument("--forecast-model", required=True)

    top = argparse.ArgumentParser(prog="custvalue", description=__doc__.split("\n")[0])
    jobs = top.add_subparsers(required=True)
    job = jobs.add_parser("fit", parents=[source, rules], help="fit and store both models")
    job.set_defaults(run=fit)
    job = jobs.add_parser("publish", parents=[source, rules], help="write every report table")
    job.add_argument("--contacts", required=True)
    job.add_argument("--geo", help="coordinates table; the known venues if left out")
    job.add_argument("--out", required=True)
    job.set_defaults(run=publish_reports)
    job = jobs.add_parser("show", help="print one document as JSON")
    job.add_argument("document", choices=DOCUMENTS)
    job.add_argument("--reports", required=True)
    job.add_argument("--location", default=DEFAULT_LOCATION)
    for name in ("year", "month", "start", "end"):
        job.add_argument(f"--{name}")
    job.set_defaults(run=show)
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(session(), args)


if __name__ == "__main__":
    main()
