"""Ranked lexical search over an inverted index that is partitioned by term.

The index holds the postings of blocks of documents, and in each block every term belongs to one of a few
owners. A bundle of items visits the owners one after the other. At each it meets, by a cogroup on block and
bundle, the owner's postings of the block, adds the integer contributions of its terms there to the scores
that it carries for the block's documents, and takes these partial scores on to the next owner. The last
owner keeps each item's best documents of the block, of which the best of all blocks are selected.

A bundle does not carry what cannot become a result: once an item's ``top`` best partial scores of a block
are known, a document whose score would stay below all of them even with the highest contribution of each
term that is still to come is left behind. This is exact, as such a document cannot reach the block's first
``top``, whatever comes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm.arrow_words import encoded_words, text_pieces

OWNERS = 4
BLOCK_BYTES = 8 << 20  # text of a block; a longer document is a block alone
BUNDLE_TERMS = 20_000  # terms of the items that travel together
TOP = 10
ROUTE_BYTES = 8 << 20  # routes of all bundles that are broadcast; beyond, they meet the blocks by a shuffle
STOP_BYTES = 32  # of a term's weight, owner and slot in a route
TF_SCALE = 1_000_000_000
TERM_LIMIT = 1_000_000  # what a term of weight 1 contributes is below this
WEIGHT_SCALE = 1_000

# Rows of a block: one with its documents (owner -1), and one per owner with its terms and their postings.
DOCUMENTS = -1
INDEX = (
    "block long, owner int, filled long, words long, doc_ids array<long>, lengths array<int>,"
    " terms array<string>, found array<int>, docs binary, counts binary"
)
ROUTE = "array<struct<owner: int, term: string, weight: long, slot: int>>"
STATE = f"block long, bundle int, route {ROUTE}, slots binary, docs binary, scores binary"
BEST = "bundle int, slot int, doc_id long, score long"


def build_index(docs: DataFrame, owners: int = OWNERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of all whole texts of ``docs(doc_id, text)``, as a stored table.

    A block's number is made of its task's number and a count; the table is written once, so all later
    passes see the same blocks.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in text_pieces(batch, block_bytes):
                yield pa.RecordBatch.from_pylist(_block(piece, block, owners), schema)
                block += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema(
        [("block", pa.int64()), ("owner", pa.int32()), ("filled", pa.int64()), ("words", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())),
         ("found", pa.list_(pa.int32())), ("docs", pa.binary()), ("counts", pa.binary())]
    )
    return materialise(texts.mapInArrow(build, INDEX))


def _block(piece: pa.RecordBatch, block: int, owners: int) -> list[dict]:
    """The index rows of one block. Postings stand by term, then by document."""
    n_docs = piece.num_rows
    distinct, words, bounds = encoded_words(piece.column("text"))
    lengths = np.diff(bounds)
    pairs, counts = np.unique(words * n_docs + np.repeat(np.arange(n_docs), lengths), return_counts=True)
    term, doc = np.divmod(pairs, n_docs)
    names = distinct.to_pylist()
    at = np.fromiter((zlib.crc32(name.encode()) % owners for name in names), np.int64, len(names))
    found = np.bincount(term, minlength=len(names))
    rows = [
        {"block": block, "owner": DOCUMENTS, "filled": int((lengths > 0).sum()), "words": int(lengths.sum()),
         "doc_ids": piece.column("doc_id").to_pylist(), "lengths": lengths.astype(np.int32)}
    ]
    for owner in range(owners):
        own = at[term] == owner
        rows.append(
            {"block": block, "owner": owner, "terms": [names[i] for i in np.flatnonzero(at == owner)],
             "found": found[at == owner].astype(np.int32), "docs": doc[own].astype(_kind(n_docs)).tobytes(),
             "counts": counts[own].astype("<u4").tobytes()}
        )
    return rows


def _kind(n_docs: int) -> str:
    """How a document's place in its block is written."""
    return "<u2" if n_docs <= 1 << 16 else "<u4"


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each item. Items of one id count as one; null or empty texts give no row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                distinct, words, bounds = encoded_words(piece.column("text"))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
                pairs = np.unique(owner * max(len(distinct), 1) + words)
                owner, words = np.divmod(pairs, max(len(distinct), 1))
                columns = [piece.column("item_id").take(pa.array(owner)), distinct.take(pa.array(words))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, f"item_id {kind}, term string").distinct()


def search(index: DataFrame, items: DataFrame, owners: int = OWNERS, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with the highest scores above 0.

    Ties go to the smaller doc_id; a null id comes last among equal scores, and rows with equal ids and
    texts are documents of their own. Items without terms, or whose terms no document holds, have no
    rows. ``owners`` must be those of the index. ``90 * N`` times the words of the longest document must
    stay below 2 ** 63.
    """
    n_docs, n_words = index.where(F.col("owner") == DOCUMENTS).agg(F.sum("filled"), F.sum("words")).first()
    wanted = materialise(item_terms(items))
    total = wanted.count()
    if not n_docs or not total:
        empty = wanted.select("item_id").where(F.lit(False))
        return empty.select(
            "item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")
        )
    bundles = -(-total // BUNDLE_TERMS)
    slots, routes = _routes(index, wanted, n_docs, owners, bundles)
    state = _departures(index, routes, bundles)
    every = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    for owner in range(owners):
        here = index.where(F.col("owner").isin(DOCUMENTS, owner)).select("*", every)
        met = state.groupBy("block", "bundle").cogroup(here.groupBy("block", "bundle"))
        if owner < owners - 1:
            state = met.applyInArrow(_visit(owner, n_docs, n_words, top), STATE)
        else:
            best = met.applyInArrow(_arrival(owner, n_docs, n_words, top), BEST)
    named = best.join(slots, ["bundle", "slot"])
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _routes(
    index: DataFrame, wanted: DataFrame, n_docs: int, owners: int, bundles: int
) -> tuple[DataFrame, DataFrame]:
    """``bundle, slot, item_id, item_no`` of the items, and each bundle's terms with weight, owner and slot."""
    keys = wanted.groupBy("item_id").count().select("item_id", F.xxhash64("item_id").alias("print"))
    places = Window.partitionBy("bundle").orderBy("print", "item_id")
    slots = keys.withColumn("bundle", F.pmod("print", F.lit(bundles)).cast("int"))
    slots = slots.withColumn("slot", F.row_number().over(places) - 1)
    slots = slots.withColumn("item_no", F.struct("bundle", "slot")).drop("print")
    slots = materialise(slots)

    each = index.select(F.explode(F.arrays_zip("terms", "found")).alias("own")).select("own.terms", "own.found")
    asked = wanted.select("term").distinct()
    held = each.join(asked, each["terms"] == asked["term"]).groupBy("term").agg(F.sum("found").alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log(ratio))
    weighed = held.select("term", weight.alias("weight"), F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(owners)).cast("int").alias("owner"))
    placed = wanted.join(weighed, "term").withColumnRenamed("item_id", "asked_id")
    placed = placed.join(slots, placed["asked_id"].eqNullSafe(slots["item_id"]))
    stop = F.struct("owner", "term", "weight", "slot")
    routes = placed.groupBy("bundle").agg(F.array_sort(F.collect_list(stop)).alias("route"))
    return slots, materialise(routes)


def _departures(index: DataFrame, routes: DataFrame, bundles: int) -> DataFrame:
    """Every bundle at every block, without scores yet.

    All blocks need each bundle. Routes of up to ``ROUTE_BYTES`` in all are broadcast. Beyond that a bundle's
    terms are repeated for a number of lanes and the blocks are dealt to these, so that no key of the join
    holds more than its share of the blocks.
    """
    stop = F.transform("route", lambda s: F.octet_length(s["term"]) + STOP_BYTES)
    size = routes.agg(F.sum(F.aggregate(stop, F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    small = size <= ROUTE_BYTES
    lanes = 1 if small else int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index.where(F.col("owner") == DOCUMENTS).select(
        F.col("block").alias("block"), F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"),
        F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"),
    )
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    none = F.lit(b"")
    laned = routes.select("bundle", "route", lane)
    met = blocks.join(F.broadcast(laned) if small else laned.hint("merge"), ["bundle", "lane"])
    return met.select("block", "bundle", "route", none.alias("slots"), none.alias("docs"), none.alias("scores"))


class _Scores:
    """The partial scores of one bundle in one block after its visit to one owner."""

    def __init__(self, left: pa.Table, right: pa.Table, owner: int, n_docs: int, n_words: int):
        state = left.slice(0, 1).to_batches()[0]
        here = {row["owner"]: i for i, row in enumerate(right.select(["owner"]).to_pylist())}
        self.documents = right.slice(here[DOCUMENTS], 1)
        lengths = self.documents.column("lengths").combine_chunks().values.to_numpy().astype(np.int64)
        self.n = len(lengths)
        route = state.column("route").flatten()
        parts = [route.field(i) for i in range(4)]
        mine = pc.equal(parts[0], owner)
        terms, weights, slots = (p.filter(mine) for p in parts[1:])
        ahead = pc.greater(parts[0], owner)
        self.route = route.filter(ahead)
        slots_ahead = self.route.field(3).to_numpy(zero_copy_only=False).astype(np.int64)
        weights_ahead = self.route.field(2).to_numpy(zero_copy_only=False)
        slots_behind = np.frombuffer(state.column("slots")[0].as_py(), "<u4").astype(np.int64)
        n_slots = 1 + max(int(slots_behind.max(initial=0)), pc.max(parts[3]).as_py() or 0)
        #: What the owners ahead can still add to a document's score, by slot.
        self.ahead = np.zeros(n_slots, np.int64)
        np.add.at(self.ahead, slots_ahead, weights_ahead * TERM_LIMIT)
        keys = slots_behind * self.n + np.frombuffer(state.column("docs")[0].as_py(), _kind(self.n))
        scores = np.frombuffer(state.column("scores")[0].as_py(), "<i8")
        new_keys, new_scores = self._added(
            right.slice(here[owner], 1), lengths, terms,
            weights.to_numpy(zero_copy_only=False), slots.to_numpy(zero_copy_only=False).astype(np.int64),
            n_docs, n_words,
        )
        self._sum(np.concatenate([keys, new_keys]), np.concatenate([scores, new_scores]))

    def _added(self, own, lengths, terms, weights, slots, n_docs, n_words):
        """What this owner's postings add: keys of slot and document, and contributions."""
        names = own.column("terms").combine_chunks().values
        found = own.column("found").combine_chunks().values.to_numpy().astype(np.int64)
        docs = np.frombuffer(own.column("docs")[0].as_py(), _kind(self.n)).astype(np.int64)
        tf = np.frombuffer(own.column("counts")[0].as_py(), "<u4").astype(np.int64)
        m = 10 + (90 * lengths * n_docs) // n_words
        part = (TF_SCALE * tf) // (1_000 * tf + 8 * m[docs])
        ends = np.cumsum(found)
        at = pc.index_in(terms, names).fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(at >= 0)
        at, weights, slots = at[held], weights[held], slots[held]
        sizes = found[at]
        # The postings of all asked terms, one after the other.
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place += np.repeat(ends[at] - sizes, sizes)
        return np.repeat(slots, sizes) * self.n + docs[place], np.repeat(weights, sizes) * part[place]

    def _sum(self, keys: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, scores = keys[order], scores[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(scores, first) if len(first) else scores[:0]
        self.slots, self.docs = np.divmod(keys[first], max(self.n, 1))
        self.scores = sums.astype(np.int64)

    def floors(self, top: int) -> np.ndarray:
        """The ``top``-th best partial score of each slot in this block; 0 with fewer."""
        out = np.zeros(len(self.ahead), np.int64)
        order = np.lexsort((-self.scores, self.slots))
        slots = self.slots[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        last = order[place == top - 1]
        out[self.slots[last]] = self.scores[last]
        return out

    def hopeful(self, top: int) -> np.ndarray:
        """Which documents can still be among the first ``top`` of the block for the slot."""
        return self.scores + self.ahead[self.slots] >= self.floors(top)[self.slots]


def _visit(owner: int, n_docs: int, n_words: int, top: int) -> Callable:
    """A bundle's stay at an owner that is not its last."""

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # no document holds a term of the bundle
            return left
        scores = _Scores(left, right, owner, n_docs, n_words)
        keep = scores.hopeful(top)
        return pa.table(
            {
                "block": [key[0].as_py()],
                "bundle": pa.array([key[1].as_py()], pa.int32()),
                "route": pa.ListArray.from_arrays([0, len(scores.route)], scores.route),
                "slots": [scores.slots[keep].astype("<u4").tobytes()],
                "docs": [scores.docs[keep].astype(_kind(scores.n)).tobytes()],
                "scores": [scores.scores[keep].astype("<i8").tobytes()],
            }
        )

    return visit


def _arrival(owner: int, n_docs: int, n_words: int, top: int) -> Callable:
    """The last owner: a block's best documents of each item in the bundle."""
    kinds = [("bundle", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]
    empty = pa.schema(kinds).empty_table()

    def arrive(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        scores = _Scores(left, right, owner, n_docs, n_words)
        keep = np.flatnonzero((scores.scores > 0) & scores.hopeful(top))
        ids = scores.documents.column("doc_ids").combine_chunks().values
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        docs, slots, sums = scores.docs[keep], scores.slots[keep], scores.scores[keep]
        order = np.lexsort((number[docs], ~known[docs], -sums, slots))
        slots = slots[order]
        order = order[np.arange(len(slots)) - np.searchsorted(slots, slots) < top]
        return pa.table(
            {
                "bundle": pa.array(np.full(len(order), key[1].as_py()), pa.int32()),
                "slot": pa.array(scores.slots[keep][order], pa.int32()),
                "doc_id": ids.take(pa.array(docs[order])),
                "score": pa.array(sums[order], pa.int64()),
            }
        )

    return arrive


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Index ``docs`` and search it for all ``items(item_id, text)``; see :func:`search`.

    A null or empty text has no terms and is not counted. Other columns are ignored.
    """
    return search(build_index(docs, owners, block_bytes), items, owners, top)
