"""Shared session and handmade inputs."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from custvalue.operators.scoring import LinearModel
from custvalue.session import session
from custvalue.sources.schemas import CONTACTS, TRANSACTIONS

CLV_SCHEMA = (
    "ctc_id long, location string, no_visit long, value double, customer_age long, recency long,"
    " days_since_last_visit long, clv_3m double, total_transaction double, frequency double"
)


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        master="local[8]",
        shuffle_partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from (ctc_id, day, source, location, value) tuples."""

    def make(*rows):
        typed = [(c, day(d), s, p, None if v is None else float(v)) for c, d, s, p, v in rows]
        return spark.createDataFrame(typed, TRANSACTIONS)

    return make


@pytest.fixture(scope="session")
def make_contacts(spark):
    """Contacts from (ctc_id, post_code, age, birth day, age_category) tuples."""

    def make(*rows):
        typed = [(c, p, a, day(b), g) for c, p, a, b, g in rows]
        return spark.createDataFrame(typed, CONTACTS)

    return make


@pytest.fixture(scope="session")
def make_clv(spark):
    """Scored rows; value doubles as total_transaction and, unless given, as clv_3m."""

    def make(*rows):
        filled = []
        for row in rows:
            item = {
                "no_visit": 1, "value": 10.0, "customer_age": 0, "recency": 0,
                "days_since_last_visit": 0, "frequency": 0.0, **row,
            }
            value = float(item["value"])
            filled.append((
                item["ctc_id"], item["location"], item["no_visit"], value, item["customer_age"],
                item["recency"], item["days_since_last_visit"], float(item.get("clv_3m", value)),
                value, float(item["frequency"]),
            ))
        return spark.createDataFrame(filled, CLV_SCHEMA)

    return make


@pytest.fixture(scope="session")
def model():
    return LinearModel(1, {"value": 0.5, "no_visit": 2})


def rows_of(df, *columns):
    """Sorted tuples of the chosen columns."""
    chosen = columns or df.columns
    return sorted((tuple(r) for r in df.select(*chosen).collect()), key=repr)
