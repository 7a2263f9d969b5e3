"""Settings that hold while an operator runs its own jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Send rows to Python in batches of about ``size``.

    Rows that hold whole texts or sets make the default batches of 64 MB, and each takes several
    times its size in buffers on both sides.
    """
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each job at its end, not when the driver's collector finds them unused.

    For operators that write a table after each step: no later job reads an earlier one's shuffle.
    """
    before = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)
