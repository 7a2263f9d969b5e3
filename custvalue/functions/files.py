"""Folders and marker files on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all it holds; nothing happens if there is none."""
    system, place = _at(spark, path)
    system.delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    system, place = _at(spark, path)
    system.create(place, False).close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no folder."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place))
