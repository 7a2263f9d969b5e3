"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from custvalue.functions.files import remove

T = TypeVar("T")

# The folder of the job that the calling thread works for.
_job: ContextVar[str | None] = ContextVar("custvalue_job", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only for a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="custvalue-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables materialised inside the block share one folder, which goes at its end, come what may.

    For jobs that write their results: a frame that still reads a materialised table must not leave
    the block. Each job has a folder of its own, also if several run in threads of one session; the
    threads of :func:`parallel` work for the job that starts them.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    before = _job.set(folder)
    try:
        yield folder
    finally:
        _job.reset(before)
        remove(spark, folder)


def parallel(tasks: Iterable[Callable[[], T]], threads: int) -> list[T]:
    """Results of tasks that start Spark jobs side by side, in order, in the caller's :func:`scratch`."""
    with ThreadPoolExecutor(threads) as pool:
        running = [pool.submit(copy_context().run, task) for task in tasks]
        return [task.result() for task in running]


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the checkpoint folder and read that from here on.

    For a frame that several passes must see with the very same values: sums of doubles can
    differ in the last bit from one evaluation to the next. A Parquet table beats
    ``checkpoint()``: each pass reads only its own columns, Spark knows the size, and size
    estimates do not pile up over rounds. The tables stay until the folder is cleaned, or until
    the end of the :func:`scratch` block they were made in.
    """
    spark = df.sparkSession
    folder = _job.get() or ensure_checkpoint_dir(spark)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table of a frame that :func:`materialise` returned and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rpartition("/")[0])
