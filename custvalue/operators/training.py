"""Fitting the two regression models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.dates import CALENDAR_COLUMNS, DateLike, as_date
from custvalue.functions.files import exists, remove
from custvalue.operators.cleaning import NO_SOURCE, distinct_rows
from custvalue.operators.features import rfm
from custvalue.operators.scoring import LinearModel, Model
from custvalue.operators.trees import TreeModel

# The folders of a linear formula and of compiled trees inside a model's folder.
LINEAR, TREES = "linear", "trees"

CLV_FEATURES = ("no_visit", "value", "customer_age", "recency", "days_since_last_visit")
# customer_age = recency + days_since_last_visit in every row, so a linear model leaves one out.
LINEAR_CLV_FEATURES = ("no_visit", "value", "recency", "days_since_last_visit")


def clv_training_set(tx: DataFrame, cutoff: DateLike, horizon_days: int = 90) -> DataFrame:
    """Features up to ``cutoff`` with ``target``, the customer's spend in the days after it."""
    day, cut = F.col("order_date"), as_date(cutoff)
    features = rfm(tx.filter(day <= cut), cut)
    future = tx.filter((day > cut) & (day <= F.date_add(cut, horizon_days)))
    spend = (
        distinct_rows(future, NO_SOURCE)
        .groupBy("ctc_id", "location")
        .agg(F.sum("value").alias("target"))
    )
    return features.join(spend, ["ctc_id", "location"], "left").na.fill(0.0, "target")


def fit_clv_model(
    training: DataFrame,
    estimator: Estimator | None = None,
    features: Sequence[str] | None = None,
    with_location: bool = True,
) -> PipelineModel:
    """Fit a value model on the visit features and, unless left out, the location.

    The default estimator is linear and takes linearly independent features; another one gets all
    features, of which trees can use any.
    """
    features = features or (CLV_FEATURES if estimator else LINEAR_CLV_FEATURES)
    place = [
        StringIndexer(inputCol="location", outputCol="_place", handleInvalid="keep"),
        OneHotEncoder(inputCol="_place", outputCol="_place_vector"),
    ]
    columns = [*features, "_place_vector"] if with_location else list(features)
    encoded = [
        *(place if with_location else []),
        VectorAssembler(inputCols=columns, outputCol="_features"),
    ]
    regressor = estimator or LinearRegression(regParam=0.01)
    regressor = regressor.copy().setFeaturesCol("_features").setLabelCol("target")
    return Pipeline(stages=[*encoded, regressor]).fit(training)


def fit_forecast_model(daily: DataFrame, estimator: Estimator | None = None) -> PipelineModel:
    """Fit daily revenue (``value``) on the calendar features."""
    assembler = VectorAssembler(inputCols=list(CALENDAR_COLUMNS), outputCol="_features")
    regressor = estimator or LinearRegression(regParam=0.01)
    regressor = regressor.copy().setFeaturesCol("_features").setLabelCol("value")
    return Pipeline(stages=[assembler, regressor]).fit(daily)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Store a fitted model, a linear formula or compiled trees, replacing what is there."""
    remove(spark, path)
    if isinstance(model, LinearModel):
        terms = [(name, float(weight)) for name, weight in model.coefficients.items()]
        row = [(float(model.intercept), terms)]
        kind = "intercept double, terms array<struct<name: string, weight: double>>"
        spark.createDataFrame(row, kind).coalesce(1).write.parquet(f"{path}/{LINEAR}")
    elif isinstance(model, TreeModel):
        spark.createDataFrame([(model.to_json(),)], "trees string").coalesce(1).write.parquet(f"{path}/{TREES}")
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Load what :func:`save_model` stored."""
    if exists(spark, f"{path}/{TREES}"):
        return TreeModel.from_json(spark.read.parquet(f"{path}/{TREES}").first()["trees"])
    if not exists(spark, f"{path}/{LINEAR}"):
        return PipelineModel.load(path)
    row = spark.read.parquet(f"{path}/{LINEAR}").first()
    return LinearModel(row["intercept"], {t["name"]: t["weight"] for t in row["terms"]})
