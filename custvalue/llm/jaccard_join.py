"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word shingles overlap in at least ``T`` shingles, where ``T``
follows from the Jaccard threshold and the set sizes. The inverted lists of a document's shingles
are divided as in DivideSkip: the ``L`` longest are set aside, with ``L`` chosen from ``T`` and the
length of the longest. The short lists are merged, which counts in how many of them each partner
occurs; one with fewer than ``T - L`` is dropped. For the others only the long lists are probed, by
binary search, and the two counts together are the overlap.

The merge is a join of the short lists on their shingle and a count per pair. A document sets aside
by the smallest ``T`` of any partner; the join sets aside more by the pair's own ``T``, the same
``L`` on both sides. All lists have one order, so of the shared shingles in that order the first
``T - L`` have at least ``L`` others behind them in both documents, and the join sees each of them.

The lists are built in packed blocks: a task sends one row per block and hash range instead of one
row per shingle. A shingle that a block has several times is sent once with its count, and its
postings wait for the list's length on the block's side, so a shingle in a third of all documents
costs one entry per block. A shingle that no other document of fitting size has is forgotten at
once; a document that keeps fewer than ``T`` shingles has no partner and drops out. What is left is
a few per cent of a corpus, with the exact length of every list.

Groups of copies never become pairs. Equal sets are one member for the rest of the search. Inside a
list, members are first paired with a few neighbours; once those links have merged most of a group
into one component, only pairs across components are still open, and the search runs over all of these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm import tokens
from custvalue.llm.graph import components
from custvalue.llm.settings import small_batches

BLOCK_SHINGLES = 2_000_000  # shingles that a task packs together
BLOCK_DOCS = 60_000  # documents of a block are numbered with 16 bits
KEY_BYTES = 5  # of a shingle's hash inside a range; the range adds its own bits
ROUNDS = 3  # of trying neighbours before all open pairs
NEAREST = 6  # partners that each member tries in the first round
MORE = 4  # times as many in each next one, where few lists are still open
LONG_COST = 0.002  # of probing a long list against merging it: the smaller, the more lists are set aside
PAIR_ASIDE = 0.98  # of a pair's ``T``: so many of the longest lists of both are probed
CROWD = 50_000  # members of a list that look for neighbours together

# Kinds of rows on the way: a block's documents, postings, counts of shingles that a block has several
# times, and the postings of these, which wait for the list's length.
HEAD, POSTINGS, COUNTS, WAITING = range(4)
PACKED = "part int, block long, kind int, keys binary, docs binary, sizes binary"
SHARED = "block long, part int, kind int, keys binary, docs binary, counts binary"
LISTS = "shingle long, ahead long, behind long, id long, member long, n long, aside long"
SETS = "doc_id long, n long, digest binary, ranked binary, aside long"


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return (np.log(np.maximum(sizes, 1)) / math.log(1.1)).astype(np.uint8)


def _pack(size: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.Words()
        task = TaskContext.get().partitionId()
        number = 0
        sets: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = docs = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, docs
            block = (task << 32) + number
            turn = (7 * task + number) % parts  # rows of no range take turns over all
            counts = np.array([len(s) for s in sets], np.int64)
            values = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), counts)
            classes = np.repeat(_size_class(counts), counts)
            order = np.argsort(values)  # by hash range, too
            values, doc, classes = values[order], doc[order], classes[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
            times = np.diff(np.append(first, len(values)))
            several = np.repeat(times > 1, times)
            column = pa.concat_arrays(names)
            known = np.asarray(column.is_valid())
            out = [(
                turn, block, HEAD, np.asarray(column.fill_null(0)).astype("<i8").tobytes(),
                known.tobytes(), counts.astype("<i8").tobytes(),
            )]
            for part, a, b in tokens.by_range(values[~several], parts):
                own = np.flatnonzero(~several)[a:b]
                out.append((
                    part, block, POSTINGS, tokens.pack_low(values[own], KEY_BYTES),
                    doc[own].tobytes(), classes[own].tobytes(),
                ))
            for part, a, b in tokens.by_range(values[first[times > 1]], parts):
                out.append((
                    part, block, COUNTS, tokens.pack_low(values[first[times > 1]][a:b], KEY_BYTES),
                    times[times > 1][a:b].astype("<u4").tobytes(), None,
                ))
            out.append((
                turn, block, WAITING, values[several].tobytes(), doc[several].tobytes(), None,
            ))
            number, held, docs = number + 1, 0, 0
            sets.clear()
            names.clear()
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            return pa.record_batch(columns, ["part", "block", "kind", "keys", "docs", "sizes"])

        for batch in batches:
            data, bounds = tokens.texts(batch.column(1))
            for first, last in tokens.pieces(bounds):
                begin, end = bounds[first], bounds[last]
                found = words.find(data[begin:end], bounds[first : last + 1] - begin)
                values, ranges = tokens.shingles(words.hash(*found[:3]), found[3], size)
                if docs and (held + len(values) > BLOCK_SHINGLES or docs + last - first > BLOCK_DOCS):
                    yield flush()
                sets += [np.unique(values[a:b]) for a, b in zip(ranges[:-1], ranges[1:])]
                names.append(batch.column(0).slice(first, last - first).cast(pa.int64()))
                held, docs = held + len(values), docs + last - first
        if docs:
            yield flush()

    return rows


def _share(reach: int):
    """Keep the postings of shingles that another document of fitting size also has."""

    def rows(table: pa.Table) -> pa.Table:
        out, packed, counted = [], [], []
        part = table.column("part")[0].as_py()
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                _, block, kind, *data = (batch.column(c)[i].as_py() for c in range(6))
                if kind in (HEAD, WAITING):
                    out.append((block, -1, kind, *data))
                else:
                    (packed if kind == POSTINGS else counted).append((block, *data))
        # Entries: postings stand for one document, counts for several of their block.
        entries = [(p, np.ones(len(p[3]), np.uint32)) for p in packed]
        entries += [(c, np.frombuffer(c[2], np.uint32)) for c in counted]
        if entries:
            keys = np.concatenate([tokens.unpack_low(e[1], KEY_BYTES) for e, _ in entries])
            times = np.concatenate([n for _, n in entries])
            sources = np.repeat(np.arange(len(entries), dtype=np.int32), [len(n) for _, n in entries])
            places = np.concatenate([np.arange(len(n), dtype=np.int32) for _, n in entries])
            classes = np.concatenate(
                [np.frombuffer(p[3], np.uint8) for p in packed] + [np.zeros(len(c[2]) // 4, np.uint8) for c in counted]
            )
            order = np.argsort(keys << np.uint64(8) | classes.astype(np.uint64))
            keys, classes, times, sources = keys[order], classes[order].astype(np.int16), times[order], sources[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            lengths = np.diff(np.append(starts, len(keys)))
            total = np.minimum(np.add.reduceat(times.astype(np.int64), starts), 65_535).astype(np.uint16)
            near = (keys[1:] == keys[:-1]) & (classes[1:] - classes[:-1] <= reach)
            keep = np.repeat(np.maximum.reduceat(times, starts) > 1, lengths)  # sizes in a block are not told
            keep[1:] |= near
            keep[:-1] |= near
            total = np.repeat(total, lengths)[keep]
            keys, sources, places = keys[keep], sources[keep], places[order][keep]
            by = np.argsort(sources, kind="stable")
            keys, sources, places, total = keys[by], sources[by], places[by], total[by]
            at = np.flatnonzero(np.diff(sources, prepend=-1))
            for a, b in zip(at, [*at[1:], len(sources)]):
                source = entries[sources[a]][0]
                posted = sources[a] < len(packed)
                docs = np.frombuffer(source[2], np.uint16)[places[a:b]].tobytes() if posted else None
                out.append((
                    source[0], part, POSTINGS if posted else COUNTS, tokens.pack_low(keys[a:b], KEY_BYTES),
                    docs, total[a:b].tobytes(),
                ))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)]
        return pa.table(columns, ["block", "part", "kind", "keys", "docs", "counts"])

    return rows


def _rank(threshold: float, parts: int):
    """Per document: size, shared shingles from the shortest list to the longest, and a digest."""

    def rows(table: pa.Table) -> pa.Table:
        keys, docs, counts = [], [], []
        known_keys, known_counts = [], []
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                _, part, kind, *data = (batch.column(c)[i].as_py() for c in range(6))
                if kind == HEAD:
                    names = np.frombuffer(data[0], "<i8")
                    known = np.frombuffer(data[1], bool)
                    sizes = np.frombuffer(data[2], "<i8")
                elif kind == WAITING:
                    values, owners = np.frombuffer(data[0], "<u8"), np.frombuffer(data[1], np.uint16)
                    whole = tokens.in_range(values, parts)
                else:
                    own = tokens.unpack_low(data[0], KEY_BYTES) | np.uint64(part) << np.uint64(40)
                    if kind == POSTINGS:
                        keys.append(own)
                        docs.append(np.frombuffer(data[1], np.uint16))
                        counts.append(np.frombuffer(data[2], np.uint16))
                    else:
                        known_keys.append(own)
                        known_counts.append(np.frombuffer(data[2], np.uint16))
        if len(whole):  # every shingle that waits has its count
            told, lengths = np.concatenate(known_keys), np.concatenate(known_counts)
            order = np.argsort(told)
            keys.append(whole)
            docs.append(owners)
            counts.append(lengths[order][np.searchsorted(told[order], whole)])
        digests: list[bytes | None] = [None] * len(sizes)
        ranked: list[bytes | None] = [None] * len(sizes)
        needed = _needed(sizes, threshold)
        aside = np.zeros(len(sizes), np.int64)
        if keys:
            keys, docs, counts = np.concatenate(keys), np.concatenate(docs), np.concatenate(counts)
            order = np.lexsort((keys, counts, docs))
            keys, docs, counts = keys[order], docs[order], counts[order]
            ranges = np.searchsorted(docs, np.arange(len(sizes) + 1))
            shared = np.diff(ranges)
            aside = _set_aside(needed, counts[np.maximum(ranges[1:] - 1, 0)])
            for d in np.flatnonzero((shared >= needed) & (sizes > 0) & known):
                own = keys[ranges[d] : ranges[d + 1]]
                ranked[d] = own.tobytes()
                if len(own) == sizes[d]:
                    digests[d] = hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest()
        return pa.table([
            pa.array(names, pa.int64(), mask=~known), pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()), pa.array(ranked, pa.binary()), pa.array(aside, pa.int64()),
        ], ["doc_id", "n", "digest", "ranked", "aside"])

    return rows


def _needed(sizes, threshold: float):
    """The least overlap with any partner: the share ``threshold`` of the own set."""
    percent = round(threshold * 100)
    return -(-percent * sizes // 100)


def _set_aside(needed: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """How many of each document's longest lists are probed: ``T / (cost * log2(longest) + 1)``, below ``T``."""
    lists = needed / (LONG_COST * np.log2(np.maximum(longest, 2)) + 1)
    return np.maximum(np.minimum(lists.astype(np.int64), needed - 1), 0)


def _short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and short list; lists without another document are not among ``ranked``."""
    for batch in batches:
        ranked = [np.frombuffer(r.as_py(), "<i8") for r in batch.column(4)]
        aside = tokens.ids(batch.column(3))
        short = np.array([max(len(r) - k, 0) for r, k in zip(ranked, aside)], np.int64)
        if not len(short):
            continue
        columns = [np.repeat(tokens.ids(batch.column(c)), short) for c in range(4)]
        cut = np.concatenate([r[:k] for r, k in zip(ranked, short)])
        ahead = np.concatenate([np.arange(k) for k in short])
        behind = np.concatenate([np.arange(len(r) - 1, len(r) - 1 - k, -1) for r, k in zip(ranked, short)])
        yield pa.record_batch([pa.array(c) for c in (cut, ahead, behind, *columns)], [f.split()[0] for f in LISTS.split(", ")])


def _probe(threshold: float):
    """Keep the pairs of neighbours, tried before any count, whose whole sets are similar."""
    percent = round(threshold * 100)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (tokens.ids(batch.column(c)) for c in range(4))
            keep = []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (4, 5))
                overlap = _common(one, two)
                if 100 * overlap >= percent * int(size_a[i] + size_b[i] - overlap):
                    keep.append(i)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return rows


def _probe_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete each candidate's count with the lists set aside, and keep those that reach ``need``.

    What both have in short lists is counted; there remain the long lists of ``a``, in which ``b`` is
    searched for, and those of ``b`` that are short for ``a``.
    """
    for batch in batches:
        a, b, hits, need, aside = (tokens.ids(batch.column(c)) for c in range(5))
        keep = []
        for i in range(batch.num_rows):
            one, two = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (5, 6))
            cut, end = (max(len(x) - int(aside[i]), 0) for x in (one, two))
            overlap = int(hits[i]) + _common(one[cut:], two) + _common(one[:cut], two[end:])
            if overlap >= need[i]:
                keep.append(i)
        yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _common(one: np.ndarray, two: np.ndarray) -> int:
    """How many values two sets share: the smaller is searched for in the larger."""
    if len(one) > len(two):
        one, two = two, one
    if len(one) == 0:
        return 0
    two = np.sort(two)
    return int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())


def shingle_sets(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """One row per document: ``n``, and for possible partners the shingles in order of list length."""
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 65_535)
    reach = math.floor(math.log(1 / threshold) / math.log(1.1)) + 1
    packed = docs.select("doc_id", "text").mapInArrow(_pack(size, parts), PACKED)
    shared = packed.groupBy("part").applyInArrow(_share(reach), SHARED)
    return materialise(shared.groupBy("block").applyInArrow(_rank(threshold, parts), SETS))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    for end in ("a", "b"):
        own = sets.select(
            F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("ranked").alias(f"set_{end}")
        )
        pairs = pairs.join(own, end)
    pairs = pairs.select("a", "b", "n_a", "n_b", "set_a", "set_b")
    return pairs.mapInArrow(_probe(threshold), "a long, b long")


def _neighbours(lists: DataFrame, turn: int, nearest: int) -> DataFrame:
    """Pairs ``(a, b)`` to try: neighbours in each list by size and, differently in each, at random.

    Only pairs in two components, and of each member's the ``nearest`` that most lists name.
    """
    crowded = lists.groupBy("shingle").count().where(F.col("count") > CROWD)
    spread = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / CROWD)), F.lit(0))
    crowds = lists.join(crowded, "shingle", "left").withColumn("crowd", spread)
    sizes = Window.partitionBy("shingle", "crowd").orderBy("n", "id")
    mixed = Window.partitionBy("shingle", "crowd").orderBy(F.xxhash64("id", "shingle", F.lit(turn)), "id")
    other = F.struct("id", "root")
    near = crowds.select("id", "root", F.array(F.lag(other).over(sizes), F.lag(other).over(mixed)).alias("to"))
    near = near.select("id", "root", F.explode("to").alias("to")).where("root <> to.root")
    pairs = near.select(F.greatest("id", "to.id").alias("a"), F.least("id", "to.id").alias("b"))
    votes = pairs.groupBy("a", "b").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    return votes.withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest).select("a", "b")


def _still_open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are in several components, with each member's ``root``."""
    known = roots.select("id", "root")
    lists = lists.drop("root").join(known, "id", "left")
    lists = lists.withColumn("root", F.coalesce("root", "id"))
    split = lists.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return lists.join(split.where("low < high").select("shingle"), "shingle", "left_semi")


def _members(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """The different sets that take part, each under an own key; an id may have several."""
    sets = sets.join(copies, "doc_id", "left_anti")
    sets = sets.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "ranked").alias("member"), "n", "aside", "ranked")
    again = materialise(sets.groupBy("id").count().where("count > 1").select("id"))
    alone = sets.join(again, "id", "left_anti")
    return alone.union(sets.join(again, "id", "left_semi").dropDuplicates(["member"]))


def _merged(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members in different components, with their ``hits`` in short lists.

    ``need`` is the overlap ``T`` that the pair must reach, ``aside`` is ``L`` and ``at_least`` is
    ``T - L``. A hit has at least ``L`` shared shingles behind it in the order of both documents, and
    with those before it they could make up ``T``.
    """
    percent = round(threshold * 100)
    one, two = lists.alias("one"), lists.alias("two")
    total = F.col("one.n") + F.col("two.n")
    need = F.floor((total * percent + (99 + percent)) / (100 + percent)).cast("long")
    aside = F.greatest("one.aside", "two.aside", F.least(F.floor(need * PAIR_ASIDE), need - 1))
    pairs = one.join(
        two,
        (F.col("one.shingle") == F.col("two.shingle"))
        & (F.col("one.root") < F.col("two.root"))
        & (F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * percent)
        & (F.least("one.behind", "two.behind") >= aside)
        & (F.least("one.ahead", "two.ahead") + 1 + F.least("one.behind", "two.behind") >= need),
    )
    merged = pairs.groupBy(F.col("one.member").alias("member_a"), F.col("two.member").alias("member_b")).agg(
        F.count("*").alias("hits"), F.max(need).alias("need"), F.max(aside).alias("aside")
    )
    return merged.withColumn("at_least", F.col("need") - F.col("aside"))


def _occurring(lists: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The links ``(a, b)`` between components, by counts in short lists and probes of the long."""
    pairs = _merged(lists, threshold).where("hits >= at_least")
    for end in ("a", "b"):
        own = members.select(
            F.col("member").alias(f"member_{end}"), F.col("id").alias(end), F.col("ranked").alias(f"set_{end}")
        )
        pairs = pairs.join(own, f"member_{end}")
    pairs = pairs.select("a", "b", "hits", "need", "aside", "set_a", "set_b")
    return pairs.mapInArrow(_probe_long, "a long, b long")


def jaccard_components(
    docs: DataFrame, size: int = 5, threshold: float = 0.75, nearest: int = NEAREST
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text, ...)``.

    ``threshold`` counts in whole per cent. Other columns of ``docs`` are ignored, whatever their
    names. A text without words, an empty one or a null has size 0 and is linked with nothing. Rows
    that repeat a doc_id count as one document that has the links of each of its texts. A row
    without doc_id gets its size and no component. An empty table gives an empty result. All words
    of a text count, however long it is.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, size, threshold, nearest)


def _components(docs: DataFrame, size: int, threshold: float, nearest: int) -> DataFrame:
    sets = shingle_sets(docs, size, threshold)
    open_ = sets.where("ranked IS NOT NULL")
    # Equal sets: one member stands for all.
    equal = open_.where("digest IS NOT NULL").select("doc_id", "digest")
    first = equal.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = equal.join(first, "digest").where("doc_id <> first").select("doc_id", "first").distinct()
    copies = materialise(copies)
    members = materialise(_members(open_, copies))
    lists = materialise(members.mapInArrow(_short_lists, LISTS))

    # First some neighbours in each list, until most of a group is one component.
    links = roots = None
    for turn in range(ROUNDS):
        alone = lists.withColumn("root", F.col("id"))
        tried = _neighbours(alone if roots is None else _still_open(lists, roots), turn, nearest * MORE**turn)
        found = materialise(_verified(tried, members, threshold))
        links = found if links is None else links.union(found)
        roots = materialise(components(links))

    # Then every partner in a list that is still in another component.
    lists = materialise(_still_open(lists, roots))
    late = materialise(_occurring(lists, members, threshold).distinct())
    ends = late
    for end in ("a", "b"):
        at = roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(at, end, "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(ends).select(F.col("id").alias("root"), F.col("root").alias("top"))

    # From members to all documents.
    every = copies.select("first").union(late.select("a")).union(late.select("b")).distinct()
    every = every.select(F.col("first").alias("id")).join(roots, "id", "left_anti")
    tops = roots.union(every.select("id", F.col("id").alias("root")))
    tops = tops.join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("top"))
    owners = copies.select(F.col("doc_id"), F.col("first").alias("id"))
    owners = owners.union(tops.select(F.col("id").alias("doc_id"), "id"))
    owners = owners.join(tops, "id").groupBy("doc_id").agg(F.min("top").alias("top"))
    owners = materialise(owners)
    result = sets.select("doc_id", F.col("n").alias("n_shingles")).join(owners, "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component.

    The document with the smallest doc_id stays. Rows that share a doc_id stay or go together; rows
    without one stay.
    """
    found = jaccard_components(docs, size, threshold)
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
