"""Table and document sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet, replacing what is there, and return it read back.

    With ``partition_by`` the rows are rebalanced on those columns first: AQE gathers small
    partitions and splits oversized ones, so one hot value becomes several files, not one task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return read_table(df.sparkSession, path, df)


def read_table(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Read a table written by :func:`write_table`.

    With ``like`` the declared types and column order of that frame are kept, since the types of
    partition columns are otherwise inferred from directory names.
    """
    if like is None:
        return spark.read.parquet(path)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def read_json(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Read documents written by :func:`write_json`.

    With ``like`` each field has the type it has in that frame, and a value that does not fit raises;
    otherwise a document is one variant in the column ``document``.
    """
    if like is None:
        return spark.read.option("singleVariantColumn", "document").json(path)
    return spark.read.schema(like.schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write one JSON document per row, missing values as ``null``."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
