"""Readers for the input tables (CSV, or any columnar format Spark reads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.sources.schemas import (
    CONTACT_HEADERS,
    CONTACTS,
    GEO,
    GEO_HEADERS,
    NULL_TOKENS,
    TRANSACTION_HEADERS,
    TRANSACTIONS,
)


WHOLE = r"^\s*([+-]?\d+)(?:\.0*)?\s*$"
EXACT = float(1 << 53)  # the largest whole number up to which doubles keep every one


def _whole(value: Column, kind: T.DataType, target: T.DataType) -> Column:
    """A whole number, which may be written like 12.0 where its column had gaps.

    Anything else raises: cutting off a fraction would make one customer of two.
    """
    wrong = F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string")))
    if isinstance(kind, T.StringType):
        number = F.regexp_extract(value, WHOLE, 1).try_cast(target)
        fits = value.rlike(WHOLE) & number.isNotNull()
    elif isinstance(kind, T.DoubleType | T.FloatType):
        value = F.when(~F.isnan(value), value)
        fits = (value == F.floor(value)) & (F.abs(value) <= EXACT)
        number = value.try_cast(target)
    else:
        return value.cast(target)
    return F.when(fits, number).when(value.isNotNull(), wrong.cast(target))


def conform(
    df: DataFrame, schema: T.StructType, headers: dict[str, str], from_text: bool = True
) -> DataFrame:
    """Select the columns of ``schema`` by file header or by our own name, cast to its types.

    With ``from_text``, texts that mean a missing value become null first; a typed format has
    nulls of its own, and 'NA' may be a name there. Columns outside the schema are dropped here, so
    the scan never reads them.
    """
    present = set(df.columns)
    file_name = {ours: theirs for theirs, ours in headers.items() if theirs in present}
    selected = []
    for field in schema.fields:
        name = file_name.get(field.name, field.name)
        value = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        if from_text and isinstance(kind, T.StringType):
            value = F.when(~value.isin(*NULL_TOKENS), value)
        if isinstance(field.dataType, T.IntegralType):
            value = _whole(value, kind, field.dataType)
        selected.append(value.cast(field.dataType).alias(field.name))
    return df.select(*selected)


def _read(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    # Columns stay text until ``conform`` types them: no inference pass over the data. All files of
    # a folder must have the same header; without ``enforceSchema`` one with another order or other
    # names raises, where it would be read by position. Quoted line breaks need ``multi_line``,
    # which makes a file unsplittable.
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Visit transactions: ctc_id, order_date, source, location, value."""
    return conform(_read(spark, path, fmt, multi_line), TRANSACTIONS, TRANSACTION_HEADERS, fmt == "csv")


def read_contacts(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Customer contacts: ctc_id, post_code, age, birth_date, age_category."""
    return conform(_read(spark, path, fmt, multi_line), CONTACTS, CONTACT_HEADERS, fmt == "csv")


def read_geo(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Location coordinates: location, latitude, longitude."""
    return conform(_read(spark, path, fmt, False), GEO, GEO_HEADERS, fmt == "csv")
