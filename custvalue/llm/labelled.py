"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """Whether a document's labels are never learned: by the checksum of its id. A null id is held out."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(folds)) == fold, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, out: Column, rows: int) -> DataFrame:
    """``text, label`` of about ``rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so the sample does not depend on the
    order of the tables. Several labels of one document count as the greatest; copies of a text count
    once. At most a little over ``rows`` ids are broadcast.
    """
    marked = labels.where(~out & F.col(label).isNotNull()).select(
        F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")
    )
    total = marked.count()
    share = 1.0 if total <= rows else rows / total
    # All bits of the hash, so that a share far below one in a million still chooses rows.
    print_ = F.xxhash64("label_id")
    place = F.pmod(print_, F.lit(1 << 20)) * F.lit(1 << 43) + F.shiftrightunsigned(print_, 21)
    chosen = marked.where(place < min(int(share * (1 << 63)), (1 << 63) - 1)) if share < 1 else marked
    chosen = chosen.groupBy("label_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    sample = sample.select("text", "label", F.xxhash64("text").alias("print"))
    return sample.groupBy("print").agg(F.first("text").alias("text"), F.max("label").alias("label")).drop("print")
