"""Schemas of the input tables and the header names they may arrive with."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("ctc_id", T.LongType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

CONTACTS = T.StructType(
    [
        T.StructField("ctc_id", T.LongType()),
        T.StructField("post_code", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("birth_date", T.DateType()),
        T.StructField("age_category", T.StringType()),
    ]
)

GEO = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# Header names of the source files.
TRANSACTION_HEADERS = {
    "CtcID": "ctc_id",
    "OrderDate": "order_date",
    "Source": "source",
    "Location": "location",
    "Transactional Value": "value",
}
CONTACT_HEADERS = {
    "CtcID": "ctc_id",
    "PostCode": "post_code",
    "Age": "age",
    "BirthDate": "birth_date",
    "Age Category": "age_category",
}
GEO_HEADERS = {
    "Location": "location",
    "Latitude": "latitude",
    "Longitude": "longitude",
}

# Texts that a pandas CSV reader takes for a missing value.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)
