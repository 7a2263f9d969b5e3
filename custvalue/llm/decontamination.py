"""Benchmark decontamination by size-partitioned MinHash containment search.

A MinHash of an item is the shingle that comes first under one hash order. It is a random shingle of
the item, so a document that contains the share ``c`` of the item's shingles has it with probability
``c``, however long the document is. Comparing whole signatures would fail here: a long document
shares hardly any minimum with a short item. So the signature of the item is searched for among the
shingles of the document, and one hit makes a candidate.

Items are partitioned by size. A partition's number of hash orders is set by its sizes: all shingles
of small items, where the minima would repeat, and enough orders for larger ones that a contaminated
document is missed with a probability below ``MISS``. A document with fewer distinct shingles than
the smallest contaminating share of a partition skips the partition. Candidates are verified by the
exact containment of the item's shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm import tokens

MISS = 1e-12  # accepted probability of overlooking one contaminated pair
BLOCK_BYTES = 64 << 20  # of benchmark text that is searched for at once
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


class Partition(NamedTuple):
    """Items of similar size: their signatures and their sets, as flat sorted arrays."""

    least: int  # fewest shared shingles of any contaminated document
    minima: np.ndarray  # sorted
    minima_item: np.ndarray
    sets: dict[int, np.ndarray]


def item_partitions(batch: pa.RecordBatch | pa.Table, size: int, percent: int) -> list[Partition]:
    """Sign the items. Partitions double in size: 1-31 shingles, 32-63, 64-127 and so on."""
    data, bounds = tokens.texts(batch.column(1))
    words = tokens.Words()
    low, starts, ends, ranges = words.find(data, bounds)
    values, ranges = tokens.shingles(words.hash(low, starts, ends), ranges, size)
    by_size: dict[int, dict[int, np.ndarray]] = {}
    for item, (a, b) in enumerate(zip(ranges[:-1], ranges[1:])):
        own = np.unique(values[a:b])
        if len(own):
            by_size.setdefault(max(5, len(own).bit_length()), {})[item] = own
    orders = math.ceil(math.log(MISS) / math.log(1 - percent / 100)) if percent < 100 else 1
    masks = tokens.numbers(orders, 41)
    partitions = []
    for _, sets in sorted(by_size.items()):
        minima, owners = [], []
        for item, own in sets.items():
            if len(own) > orders:
                own = np.unique([own[np.argmin(tokens.mix(own ^ mask))] for mask in masks])
            minima.append(own)
            owners.append(np.full(len(own), item))
        flat, owner = np.concatenate(minima), np.concatenate(owners)
        order = np.argsort(flat, kind="stable")
        least = min(-(-percent * len(s) // 100) for s in sets.values())
        partitions.append(Partition(least, flat[order], owner[order], sets))
    return partitions


def contained(own: np.ndarray, partitions: list[Partition], percent: int) -> list[tuple[int, int, int]]:
    """``(item, shared, size)`` of the items that the sorted set ``own`` contains."""
    out = []
    for part in partitions:
        if len(own) < part.least:
            continue
        # The signatures are few: each is looked up in the document's sorted set.
        at = np.minimum(np.searchsorted(own, part.minima), len(own) - 1)
        for item in np.unique(part.minima_item[own[at] == part.minima]):
            wanted = part.sets[item]
            at_all = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[at_all] == wanted).sum())
            if 100 * shared >= percent * len(wanted):
                out.append((int(item), shared, len(wanted)))
    return out


class Finder:
    """Looks for the items of some partitions in batches of texts."""

    def __init__(self, partitions: list[Partition], size: int, percent: int):
        self.partitions, self.size, self.percent = partitions, size, percent
        self.every = np.unique(np.concatenate([p.minima for p in partitions]))

    def find(self, column: pa.Array, words: tokens.Words) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item, shared, size)`` of the contaminated pairs."""
        data, bounds = tokens.texts(column)
        for first, last in tokens.pieces(bounds):
            begin, end = bounds[first], bounds[last]
            low, starts, ends, ranges = words.find(data[begin:end], bounds[first : last + 1] - begin)
            values, ranges = tokens.shingles(words.hash(low, starts, ends), ranges, self.size)
            # Most documents hold no minimum at all; one pass over the run finds the others.
            at = np.minimum(np.searchsorted(self.every, values), len(self.every) - 1)
            hits = np.flatnonzero(self.every[at] == values)
            for d in np.unique(np.searchsorted(ranges, hits, "right") - 1):
                own = np.unique(values[ranges[d] : ranges[d + 1]])
                for item, shared, total in contained(own, self.partitions, self.percent):
                    yield first + int(d), item, shared, total


def _search(finder: Finder, items: pa.Array):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.Words()
        for batch in batches:
            found = list(finder.find(batch.column(1), words))
            docs, item, shared, sizes = (list(c) for c in zip(*found)) if found else ([], [], [], [])
            yield pa.record_batch([
                batch.column(0).take(pa.array(docs, pa.int64())).cast(pa.int64()),
                items.take(pa.array(item, pa.int64())).cast(pa.int64()),
                pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.array(shared, float) / np.maximum(np.array(sizes, float), 1)),
            ], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return rows


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of bounded size; a small benchmark is one block."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield own.select(F.col("item_id").cast("long"), "text").toArrow()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    threshold: float = 0.75,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs ``doc_id, item_id`` where the document has at least ``threshold`` of the item's shingles.

    ``docs(doc_id, text, ...)`` is read once per block of ``benchmark(item_id, text, ...)``; a block's
    size is bounded, so its index travels with the tasks whatever the benchmark's size. ``threshold``
    counts in whole per cent. A text with fewer than ``size`` words is one shingle, its whole
    sequence, so a short item is found only in documents of just these words. Null and empty texts
    contain nothing and are contained in nothing. Repeated rows give repeated pairs, null ids stay
    null. Other columns are not used, whatever their names. An empty table gives an empty result.
    Documents are read whole.
    """
    docs = docs.select("doc_id", "text").where("text IS NOT NULL")
    found = [
        docs.mapInArrow(_search(finder, items), SCHEMA)
        for finder, items in _finders(benchmark, size, threshold, block_bytes)
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.union, found)


def _finders(benchmark: DataFrame, size: int, threshold: float, block_bytes: int) -> Iterator[tuple[Finder, pa.Array]]:
    percent = round(threshold * 100)
    for table in _blocks(benchmark, block_bytes):
        partitions = item_partitions(table, size, percent)
        if partitions:
            yield Finder(partitions, size, percent), table.column(0).combine_chunks()


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    threshold: float = 0.75,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item as :func:`contaminated` has it.

    Rows pass through one filter per block of the benchmark, without a shuffle. Null and empty texts
    stay.
    """
    text = docs.columns.index("text")
    schema = docs.schema

    def without(finder: Finder):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = tokens.Words()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in finder.find(batch.column(text), words)]] = False
                yield batch.filter(pa.array(keep))

        return rows

    for finder, _ in _finders(benchmark, size, threshold, block_bytes):
        docs = docs.mapInArrow(without(finder), schema)
    return docs
