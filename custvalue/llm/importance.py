"""Drawing documents by importance towards a target text, by hashed n-gram features.

A document's features are its runs of up to ``max_n`` words, hashed into buckets. A bucket's gain is the
log ratio of its smoothed shares in the target and in all documents; a document's weight is the sum of
its features' gains. A Gumbel number from the document's id is added, and the highest sums are drawn,
which draws without replacement in proportion to the exponential of the weights.

Inside tasks everything is an Arrow or NumPy kernel over many texts at once: words are cut and
dictionary-encoded, shifted dictionary indices form the n-grams, only distinct n-grams are hashed, and
the gains are taken by index and summed by segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm.arrow_words import encoded_words, text_pieces
from custvalue.operators.ranks import order_statistics

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 10  # percent of the documents with enough words
SEED = 2024
GAIN_SCALE = 1_000  # gains and Gumbel numbers are thousandths


def word_buckets(texts: pa.Array, max_n: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per n-gram length: the buckets of all n-grams in order, and each text's bounds; then word counts.

    An n-gram of length n is a pair of the distinct run of n - 1 words that begins it and its last word,
    both as numbers, so only distinct pairs become bytes and are hashed.
    """
    distinct, words, bounds = encoded_words(texts)
    ends = [value.encode() for value in distinct.to_pylist()]
    names, grams, spans = ends, words, bounds
    found, limits = [], []
    for n in range(1, max_n + 1):
        if n > 1:
            counts = np.maximum(np.diff(spans) - 1, 0)
            whole = np.ones(len(grams), bool)
            whole[spans[1:][np.diff(spans) > 0] - 1] = False  # a text's last run has no word after it
            first = np.flatnonzero(whole)
            owner = np.searchsorted(spans, first, "right") - 1
            last = words[first - spans[:-1][owner] + bounds[:-1][owner] + n - 1]
            pairs, grams = np.unique(grams[first] * len(distinct) + last, return_inverse=True)
            left, right = np.divmod(pairs, max(len(distinct), 1))
            names = [names[a] + b" " + ends[b] for a, b in zip(left, right)]
            spans = np.concatenate([[0], np.cumsum(counts)])
        hashed = np.fromiter((zlib.crc32(name) % buckets for name in names), np.int64, len(names))
        found.append(hashed[grams] if len(grams) else np.zeros(0, np.int64))
        limits.append(spans)
    return found, limits, np.diff(bounds)


def _counting(max_n: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per bucket that the task has seen, whatever the number of texts."""
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in text_pieces(batch):
                for found in word_buckets(piece.column("text"), max_n, buckets)[0]:
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return count


def _weighing(gains: np.ndarray, max_n: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                found, limits, n_words = word_buckets(piece.column("text"), max_n, len(gains))
                weight, features = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
                for hashed, spans in zip(found, limits):
                    sums = np.concatenate([[0], np.cumsum(gains[hashed])])
                    weight += sums[spans[1:]] - sums[spans[:-1]]
                    features += np.diff(spans)
                columns = [piece.column("doc_id"), pa.array(n_words), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def bucket_counts(texts: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often the features of all texts fall into each bucket. Empty buckets are left out."""
    counted = texts.select("text").mapInArrow(_counting(max_n, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket. The counts of at most ``buckets`` buckets come to the driver."""
    counts = []
    for texts in (docs, target):
        n = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, max_n, buckets).collect():
            n[row["bucket"]] = row["n"]
        counts.append(n.tolist())
    s, t = counts
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    ratios = [float((b + 1) * all_s) / float((a + 1) * all_t) for a, b in zip(s, t)]
    return np.array([math.floor(GAIN_SCALE * math.log(ratio)) for ratio in ratios], np.int64)


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of a Gumbel number from the first 32 bits of the id's digest. A null id is an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(GAIN_SCALE)) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    buckets: int = BUCKETS,
    share: int = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's weight and score towards ``target``, and the rank of those that are drawn.

    Returns ``doc_id, n_features, weight, score, rank``. Of the documents with ``min_words`` words or more,
    ``share`` percent (rounded down) with the highest scores are drawn, ties by the smaller id; ``rank`` is
    null for the others. A null or empty text has no features and the weight 0, and is never drawn if
    ``min_words`` is above 0. Rows with equal ids and texts count each by itself and get ranks one after
    the other; a null id comes last among equal scores. Without a target, or without documents, counts are
    0. Other columns are ignored. The gains (``buckets`` numbers) are all that tasks get from the driver.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = bucket_gains(texts, target.select(F.col("text").cast("string").alias("text")), max_n, buckets)
    kind = "doc_id long, n_words long, n_features long, weight long"
    weighed = texts.mapInArrow(_weighing(gains, max_n), kind)
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
    return _ranked(scored, share, min_words)


def _ranked(scored: DataFrame, share: int, min_words: int) -> DataFrame:
    """The rank of the first documents by score and id, without sorting all in one task.

    An exact selection finds the last score that is drawn. The documents from there up are sorted in
    ranges, and a document's rank is its place in its range after the sizes of the ranges before. Rows
    that are equal in everything are told apart by their place in the stored table, so that many of them
    still fall into several ranges; they may swap ranks, which does not change the result.
    """
    out = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= min_words).select(F.lit(1).alias("one"), "score")
    taken = able.count() * share // 100
    none = F.lit(None).cast("long").alias("rank")
    if not taken:
        return scored.select(*out, none)
    wanted = {"cut": lambda n: n - (taken - 1)}
    cut = order_statistics(able, "score", wanted, ["one"]).first()["cut"]
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features"), F.col("tie")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(
        scored.withColumn("tie", F.monotonically_increasing_id())
        .where(chosen)
        .repartitionByRange(parts, *order)
        .withColumn("part", F.spark_partition_id())
    )
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.withColumn("place", inside).join(offsets, "part")
    rank = F.col("place") + F.col("offset")
    drawn = ranked.select(*out, F.when(rank <= taken, rank).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~chosen).select(*out, none))
