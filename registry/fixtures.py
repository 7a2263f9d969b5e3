"""Visit transactions, contacts and coordinates derived from the test tables.

Values are whole numbers, so sums do not depend on row order and roundings agree between engines.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.materialise import ensure_checkpoint_dir
from custvalue.functions.rounding import half_even
from custvalue.operators.scoring import LinearModel
from custvalue.operators.trees import TreeModel
from custvalue.plans import Inputs
from custvalue.rules import Rules
from custvalue.sources.schemas import CONTACT_HEADERS, TRANSACTION_HEADERS

RULES = Rules(
    actuals_start="1997-01-01",
    actuals_end="1997-12-31",
    forecast_start="1997-01-01",
    forecast_end="1998-01-30",
    default_year=1997,
)
CLV_MODEL = LinearModel(
    5,
    {
        "no_visit": 12,
        "value": 0.513711,
        "customer_age": 0.01,
        "recency": 0.02,
        "days_since_last_visit": -0.03,
    },
)
FORECAST_MODEL = LinearModel(
    1000, {"month": 10, "year": 0.5, "day_of_week": 25, "day_of_year": 1.5}
)
# Boosted trees fitted once on line-level visits, by training.fit_clv_model and trees.compile_trees.
TREE_MODEL = TreeModel.from_json((Path(__file__).parent / "clv_trees.json").read_text())
AGE_BANDS = ("18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+")
PLACE = "NATION_3"
CSV_FILES = 4


class Tables:
    """The test tables of one scale factor, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, table)
        return table


def raw_line_visits(t: Tables) -> DataFrame:
    """One visit per order line at the supplier's nation; order_date is still a timestamp."""
    amount = F.floor("l_extendedprice").cast("double")
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("ctc_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_orderpriority").alias("source"),
            F.col("n_name").alias("location"),
            F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("value"),
            "l_linenumber",
        )
    )


def line_visits(t: Tables) -> DataFrame:
    """Typed line-level visits: many locations per customer."""
    return raw_line_visits(t).drop("l_linenumber").withColumn(
        "order_date", F.col("order_date").cast("date")
    )


def line_visits_with_copies(t: Tables) -> DataFrame:
    """Line-level visits plus copies of first lines, unchanged and from another source.

    One join feeds all three: each row is repeated in place.
    """
    copies = F.when(
        F.col("l_linenumber") == 1, F.array(F.col("source"), F.col("source"), F.lit("COPY"))
    ).otherwise(F.array(F.col("source")))
    return (
        raw_line_visits(t)
        .withColumn("source", F.explode(copies))
        .drop("l_linenumber")
        .withColumn("order_date", F.col("order_date").cast("date"))
    )


def order_visits(t: Tables) -> DataFrame:
    """Typed order-level visits: one location per customer."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("ctc_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_orderpriority").alias("source"),
            F.col("n_name").alias("location"),
            F.floor("o_totalprice").cast("double").alias("value"),
        )
    )


def contacts(t: Tables) -> DataFrame:
    """Contacts with missing post codes, and no age category for a negative balance."""
    bands = F.array(*[F.lit(band) for band in AGE_BANDS])
    band = F.get(bands, (F.col("c_custkey") % len(AGE_BANDS)).cast("int"))
    return t.customer.select(
        F.col("c_custkey").alias("ctc_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("post_code"),
        (18 + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.lit(None).cast("date").alias("birth_date"),
        F.when(F.col("c_acctbal") >= 0, band).alias("age_category"),
    )


def geo(t: Tables) -> DataFrame:
    """Invented coordinates per nation."""
    key = F.col("n_nationkey")
    return t.nation.select(
        F.col("n_name").alias("location"),
        half_even(50 + key * F.lit(0.12345), 3).alias("latitude"),
        half_even(-3 + key * F.lit(0.23456), 3).alias("longitude"),
    )


def _as_csv(df: DataFrame, headers: dict[str, str]) -> str:
    """Write ``df`` as several text files under the given file headers; the folder's path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    named = df.select(*[F.col(ours).alias(theirs) for theirs, ours in headers.items()])
    named = named.repartition(CSV_FILES, *named.columns[:1])
    named.write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss", escape='"')
    return path


def csv_transactions(t: Tables) -> str:
    """The raw line-level visits as a folder of text files."""
    return _as_csv(raw_line_visits(t), TRANSACTION_HEADERS)


def csv_contacts(t: Tables) -> str:
    """The contacts as a folder of text files."""
    return _as_csv(contacts(t), CONTACT_HEADERS)


def line_inputs(t: Tables) -> Inputs:
    return Inputs(line_visits(t), contacts(t), geo(t), CLV_MODEL, FORECAST_MODEL)


def order_inputs(t: Tables) -> Inputs:
    return Inputs(order_visits(t), contacts(t), geo(t), CLV_MODEL, FORECAST_MODEL)
