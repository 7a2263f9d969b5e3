"""Pluggable regression scorers: a linear formula, compiled trees, or a fitted Spark ML model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.rounding import half_even
from custvalue.operators.trees import TreeModel

LABEL_DECIMALS = 4


@dataclass(frozen=True)
class LinearModel:
    """intercept + sum of coefficient * column, terms added in the order given."""

    intercept: float
    coefficients: Mapping[str, float] = field(default_factory=dict)

    def expression(self) -> Column:
        terms = [F.lit(float(w)) * F.col(name) for name, w in self.coefficients.items()]
        return reduce(lambda total, term: total + term, terms, F.lit(float(self.intercept)))


Model = LinearModel | TreeModel | Transformer


def score(df: DataFrame, model: Model, out_col: str) -> DataFrame:
    """Add the model's prediction as ``out_col``, rounded to four decimals.

    A Spark ML model may add working columns; only its ``prediction`` is kept.
    """
    if isinstance(model, (LinearModel, TreeModel)):
        return df.withColumn(out_col, half_even(model.expression(), LABEL_DECIMALS))
    scored = model.transform(df)
    return scored.select(*df.columns, half_even("prediction", LABEL_DECIMALS).alias(out_col))


def score_clv(rfm: DataFrame, model: Model) -> DataFrame:
    """Feature rows with predicted three-month value, ``total_transaction`` and ``frequency``.

    ``total_transaction`` is the customer's mean value at the location, which every "revenue"
    figure of the reports adds up.
    """
    return score(rfm, model, "clv_3m").withColumns(
        {
            "total_transaction": F.col("value"),
            "frequency": half_even(F.col("recency") / F.col("no_visit"), 3),
        }
    )
