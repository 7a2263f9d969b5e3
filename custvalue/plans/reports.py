"""Building and publishing the report tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.dates import DateLike
from custvalue.functions.files import children, exists, mark, remove
from custvalue.functions.materialise import materialise, parallel, scratch
from custvalue.operators import age, cleaning, features, overview, period_table, segments, series, weekday
from custvalue.operators.cleaning import NestedVisits
from custvalue.operators.scoring import Model, score_clv
from custvalue.plans import increments
from custvalue.rules import DEFAULT_RULES, Rules
from custvalue.sources.writers import read_table, write_table

T = TypeVar("T")

# Summaries ask for a year or a date range of first visits, so that table is laid out by year.
PARTITIONING = {"first_visit": ("year",)}
PARALLEL_WRITES = 4
KEPT_VERSIONS = 2
DONE = "_COMPLETE"
TABLES = (
    "as_of",
    "clv",
    "actual_totals",
    "forecast_totals",
    "location_overview",
    "age_analytics",
    "weekday_revenue",
    "segments",
    "first_visit",
    "period_totals",
    "period_idle",
    "locations",
)


@dataclass(frozen=True)
class Inputs:
    """What every report starts from; ``transactions`` must already be typed."""

    transactions: DataFrame
    contacts: DataFrame
    geo: DataFrame
    clv_model: Model
    forecast_model: Model


def scored_clv(
    inputs: Inputs, as_of: DateLike | None = None, visits: NestedVisits | None = None
) -> DataFrame:
    """Scored features per customer and location, from nested visits if they are there."""
    return score_clv(features.rfm(visits or inputs.transactions, as_of), inputs.clv_model)


def stored_visits(inputs: Inputs, seen: DataFrame | None = None) -> NestedVisits:
    """The distinct transactions as a stored table, from which every report on visits starts.

    ``seen`` are their stored :func:`cleaning.seen_places`, if there are any.
    """
    return cleaning.nested_distinct(inputs.transactions, seen=seen).stored()


class Reports(dict[str, DataFrame]):
    """Published tables by name, with the rules they were built by."""

    def __init__(self, tables: dict[str, DataFrame], rules: Rules):
        super().__init__(tables)
        self.rules = rules


def _once(build: Callable[[], T]) -> Callable[[], T]:
    """``build``, run by the first of the threads that need its result."""
    lock, results = Lock(), []

    def get() -> T:
        with lock:
            if not results:
                results.append(build())
        return results[0]

    return get


def report_builders(
    inputs: Inputs,
    clv: DataFrame,
    as_of: DateLike,
    rules: Rules = DEFAULT_RULES,
    nested: NestedVisits | None = None,
    locations: DataFrame | None = None,
    facts: segments.Facts | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """How to build every report on the scored table, by name; building may run jobs.

    Most of them read ``clv``, so it should be a written or materialised table. The widest shuffle,
    the distinct transactions, happens once, in ``nested``: the daily series unfold it, and the reports by
    age and by weekday both start from the visits stored from it.
    """
    tx = inputs.transactions
    nested = nested or stored_visits(inputs)
    visits = _once(lambda: materialise(age.visits(nested)))
    periods = _once(lambda: period_table.period_tables(features.first_visit(clv, as_of), rules))
    contacts = cleaning.clean_contacts(inputs.contacts)

    def actual() -> DataFrame:
        daily = series.daily_revenue(nested, rules.actuals_start, rules.actuals_end)
        return series.cumulative(daily, "value")

    def predicted() -> DataFrame:
        span = (rules.forecast_start, rules.forecast_end)
        return series.cumulative(
            series.forecast(tx.sparkSession, *span, inputs.forecast_model), "label"
        )

    return {
        # Those with several passes of their own come first.
        "segments": lambda: segments.segments(clv, rules, facts),
        "age_analytics": lambda: age.age_analytics(visits(), clv, contacts, rules),
        "period_totals": lambda: periods().totals,
        "period_idle": lambda: periods().idle,
        "first_visit": lambda: features.first_visit(clv, as_of),
        "weekday_revenue": lambda: weekday.weekday_revenue(visits()),
        "location_overview": lambda: overview.with_geo(
            overview.location_overview(clv, rules), inputs.geo
        ),
        "actual_totals": actual,
        "forecast_totals": predicted,
        "locations": lambda: overview.locations(tx) if locations is None else locations,
    }


def report_tables(
    inputs: Inputs,
    clv: DataFrame,
    as_of: DateLike,
    rules: Rules = DEFAULT_RULES,
    nested: NestedVisits | None = None,
) -> Reports:
    """Every report built on the scored table, by name. Those that run jobs for it do so side by side."""
    builders = report_builders(inputs, clv, as_of, rules, nested)
    return Reports(dict(zip(builders, parallel(builders.values(), PARALLEL_WRITES))), rules)


def publish(
    inputs: Inputs,
    path: str,
    rules: Rules = DEFAULT_RULES,
    with_transactions: bool = False,
    state: str | None = None,
) -> Reports:
    """Write every table and the rules as a new version under ``path``; return them read back.

    The as-of date, the nested visits and the scored table go first; the other reports read those written
    copies, so the features are computed once, and a lost executor costs no more than its own tasks.
    ``with_transactions`` also writes the transactions, and the reports read that copy: worth it
    for text inputs, which two passes would parse otherwise. With ``state``, a folder kept by
    :func:`increments.update_state`, the transactions of ``inputs`` are new ones: they are merged into the
    state, and the reports are those of all transactions so far.

    A version is a folder of its own, and a marker file in it, written last, makes it the one that
    :func:`load_reports` reads. So readers see the tables of one run only, and a run that fails
    changes nothing. The version before stays for those who still read it; older ones go.
    """
    spark = inputs.transactions.sparkSession
    version = f"{path}/{_new_version()}"

    def write(name: str, df: DataFrame) -> DataFrame:
        return write_table(df, f"{version}/{name}", PARTITIONING.get(name, ()))

    tables = {}
    try:
        with scratch(spark):
            if with_transactions:
                tables["transactions"] = write("transactions", inputs.transactions)
                inputs = replace(inputs, transactions=tables["transactions"])
            if state is None:
                seen = materialise(cleaning.seen_places(inputs.transactions))
                tables["as_of"] = write("as_of", cleaning.as_of(seen))
                today = tables["as_of"].scalar()
                nested, places = stored_visits(inputs, seen), overview.locations(seen)
                scored = scored_clv(inputs, today, nested)
            else:
                latest = increments.update_state(spark, state, inputs.transactions).as_of
                day = F.lit(latest).cast("date").alias("as_of")
                tables["as_of"] = write("as_of", spark.range(1).select(day))
                today = tables["as_of"].scalar()
                nested = increments.state_visits(spark, state)
                places = increments.state_locations(spark, state)
                scored = score_clv(increments.state_features(spark, state), inputs.clv_model)
            scored, seen = segments.observed(scored)
            tables["clv"] = write("clv", scored)
            facts = segments.facts_of(seen)
            builders = report_builders(inputs, tables["clv"], today, rules, nested, places, facts)
            # The reports do not depend on each other: small ones fill the cluster beside large ones.
            writes = [lambda name=name, build=build: write(name, build()) for name, build in builders.items()]
            tables.update(zip(builders, parallel(writes, PARALLEL_WRITES), strict=True))
            text = spark.createDataFrame([(json.dumps(asdict(rules)),)], "rules string")
            write_table(text, f"{version}/rules")
    except BaseException:
        remove(spark, version)
        raise
    mark(spark, f"{version}/{DONE}")
    _remove_older(spark, path)
    return Reports(tables, rules)


def _new_version() -> str:
    """A folder name that sorts after all earlier ones."""
    now = datetime.now(timezone.utc)
    return f"version-{now:%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of complete versions, the latest last."""
    named = [f"{path}/{name}" for name in children(spark, path) if name.startswith("version-")]
    return [folder for folder in named if exists(spark, f"{folder}/{DONE}")]


def _remove_older(spark: SparkSession, path: str) -> None:
    for folder in _versions(spark, path)[:-KEPT_VERSIONS]:
        remove(spark, folder)


def load_reports(spark: SparkSession, path: str) -> Reports:
    """The tables and rules of the latest complete :func:`publish`."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no published reports in {path}")
    tables = {name: read_table(spark, f"{versions[-1]}/{name}") for name in TABLES}
    # Partition values come back as the narrowest integer type.
    tables["first_visit"] = tables["first_visit"].withColumn("year", F.col("year").cast("long"))
    rules = Rules(**json.loads(read_table(spark, f"{versions[-1]}/rules").first()["rules"]))
    return Reports(tables, rules)
