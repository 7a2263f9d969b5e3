"""Exact substring removal by distributed prefix doubling.

A string of ``length`` bytes that occurs again is found by ranks of suffix prefixes. The first ranks
are names (64-bit hashes) of prefixes of ``length / 2`` bytes; doubling pairs the rank at a position
with the rank at the offset ``length / 2`` and sorts the pairs, which gives ranks of prefixes of
``length``. There the threshold is reached and the positions with equal rank are the repeats.

Sorting every position would move many times the corpus. Two things avoid this:

* In the first round only *anchors* are sorted: of all half prefixes inside a full string, the one
  with the smallest name (with ties, each of them). Equal strings have equal anchors, so a string
  whose anchor is unique in the corpus is unique itself, and its positions leave before the second
  round. A few per cent of positions are anchors, and what a task's block has several times is
  sent once with its count.
* In the second round, all strings that share an anchor travel together as one fragment of text, and
  the ranks are named and paired where they are sorted. Strings of equal rank are compared byte by
  byte, so names only propose repeats. Equal fragments of one task are one entry,
  so a passage or document with thousands of copies is sent once per task. The strings around an
  anchor that very many places have, such as a common line in different texts, are dealt out by
  their next bytes as well: equal strings agree in these, so they still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm import tokens

CHUNK = 1 << 20  # positions handled at once
BLOCK_ANCHORS = 1_000_000  # that a task packs together
BLOCK_DOCS = 60_000
FRAGMENT_BYTES = 8 << 20  # that a task packs together
RUN = 4096  # most starts in one fragment
KEY_BYTES = 5
CROWDED = 1_000  # places from which on an anchor's strings are dealt out by more bytes
SPREAD = 4  # hash ranges per shuffle partition in the second round
LAST = (1 << 63) - 1  # a missing doc_id comes after all others

# Kinds of rows on the way: a block's documents, anchors that it has once, counts of those that it has
# several times, and the places of these, which wait for the count of the whole corpus.
HEAD, POSTINGS, COUNTS, WAITING = range(4)
ANCHORS = "part int, block long, kind int, keys binary, docs binary, places binary"
SHARED_SCHEMA = "block long, part int, kind int, keys binary, docs binary, places binary, crowded binary"
ALIVE = "id long, print long, alive binary, crowded binary"
FRAGMENTS = (
    "part int, bytes binary, lengths binary, ids binary, prints binary, starts binary,"
    " gone_ids binary, gone_prints binary, gone_from binary, gone_to binary"
)
GONE = "id long, print long, gone binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans binary"


class Names:
    """Names of all strings of one length in a byte array."""

    def __init__(self):
        self.salt = tokens.numbers(256, 53)
        base = int(tokens.numbers(1, 59)[0])
        steps = np.full(CHUNK + RUN, base, np.uint64)
        back = np.full(CHUNK + RUN, pow(base, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(steps), np.cumprod(back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.salt[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, size: int) -> np.ndarray:
        return (sums[size:] - sums[:-size]) * self.inverse[: len(sums) - size]


def _sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each run of ``width`` values, in steps of doubling width."""
    count = len(values) - width + 1
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:count], values[width - size : width - size + count])


def _chunks(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges to handle at once, and the document bounds in each.

    Ranges hold whole documents; a longer document is cut into ranges that overlap by ``length - 1``.
    """
    for first, last in tokens.pieces(bounds, CHUNK):
        begin, end = int(bounds[first]), int(bounds[last])
        if end - begin <= CHUNK:
            yield begin, end, bounds[first : last + 1]
        else:
            step = CHUNK - length + 1
            for a in range(begin, end - length + 1, step):
                b = min(a + CHUNK, end)
                yield a, b, np.array([a, b])


def _minima(names: Names, data: np.ndarray, inner: np.ndarray, length: int):
    """Names of half prefixes, and for each start of a full string the least name inside, or 0."""
    half = length // 2
    short = names.of(names.sums(data), half)
    least = _sliding(np.minimum, short, length - half + 1)
    cross = np.zeros(len(data) + 1, np.int32)  # strings that would reach into the next document
    cuts = inner[1:-1]
    np.add.at(cross, np.maximum(cuts - length + 1, 0), 1)
    np.add.at(cross, cuts, -1)
    least = np.where(np.cumsum(cross)[: len(least)] == 0, least, np.uint64(0))
    return short, least


def _anchors(length: int, parts: int):
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        task = TaskContext.get().partitionId()
        number = count = held = 0
        packed: list[tuple[np.ndarray, ...]] = []  # keys, documents of the block, places
        heads: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            block = (task << 32) + number
            turn = (7 * task + number) % parts  # rows of no range take turns over all
            out = [(
                turn, block, HEAD, None,
                np.concatenate([h[0] for h in heads]).tobytes(), np.concatenate([h[1] for h in heads]).tobytes(),
            )]
            key, doc, place = (np.concatenate(c) for c in zip(*packed))
            order = np.argsort(key)
            key, doc, place = key[order], doc[order], place[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            several = np.repeat(times > 1, times)
            single, repeated = np.flatnonzero(~several), first[times > 1]
            for part, a, b in tokens.by_range(key[single], parts):
                own = single[a:b]
                out.append((
                    part, block, POSTINGS, tokens.pack_low(key[own], KEY_BYTES), doc[own].tobytes(), place[own].tobytes(),
                ))
            counts = times[times > 1].astype("<u4")
            for part, a, b in tokens.by_range(key[repeated], parts):
                low = tokens.pack_low(key[repeated[a:b]], KEY_BYTES)
                out.append((part, block, COUNTS, low, counts[a:b].tobytes(), None))
            waiting = (key[several].tobytes(), doc[several].tobytes(), place[several].tobytes())
            out.append((turn, block, WAITING, *waiting))
            packed.clear()
            heads.clear()
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            return pa.record_batch(columns, ["part", "block", "kind", "keys", "docs", "places"])

        for batch in batches:
            data, bounds = tokens.texts(batch.column(3))
            own, prints = tokens.ids(batch.column(1)), tokens.ids(batch.column(2))
            for begin, end, inner in _chunks(bounds, length):
                if end - begin < length:
                    continue
                short, least = _minima(names, data[begin:end], inner - begin, length)
                pad = np.zeros(length - half, np.uint64)
                top = _sliding(np.maximum, np.concatenate([pad, least, pad]), length - half + 1)
                found = np.flatnonzero((top == short) & (short != 0))
                if len(found) == 0:
                    continue
                docs, doc = np.unique(np.searchsorted(bounds, begin + found, "right") - 1, return_inverse=True)
                if held and (held + len(found) > BLOCK_ANCHORS or count + len(docs) > BLOCK_DOCS):
                    yield flush()
                    number, count, held = number + 1, 0, 0
                heads.append((own[docs], prints[docs]))
                place = (begin + found - bounds[docs[doc]]).astype(np.uint32)
                packed.append((tokens.mix(short[found]), (doc + count).astype(np.uint16), place))
                count, held = count + len(docs), held + len(found)
        if held:
            yield flush()

    return rows


def _rows(table: pa.Table) -> Iterator[tuple]:
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _repeated(table: pa.Table) -> pa.Table:
    """First round: sort the anchors by rank and keep those that are not unique."""
    out, packed, counted = [], [], []
    part = table.column("part")[0].as_py()
    for _, block, kind, *data in _rows(table):
        if kind in (HEAD, WAITING):
            out.append((block, -1, kind, *data, None))
        else:
            (packed if kind == POSTINGS else counted).append((block, *data))
    # Entries: postings stand for one place, counts for several of their block.
    entries = [(p, np.ones(len(p[2]) // 2, np.uint32)) for p in packed]
    entries += [(c, np.frombuffer(c[2], "<u4")) for c in counted]
    if entries:
        keys = np.concatenate([tokens.unpack_low(e[1], KEY_BYTES) for e, _ in entries])
        times = np.concatenate([n for _, n in entries]).astype(np.int64)
        sources = np.repeat(np.arange(len(entries), dtype=np.int32), [len(n) for _, n in entries])
        order = np.argsort(keys)
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.append(first, len(keys))))
        at = np.searchsorted(sources, np.arange(len(entries) + 1))
        for (source, _), a, b, posted in zip(entries, at, at[1:], [True] * len(packed) + [False] * len(counted)):
            keep = total[a:b] > 1
            if not keep.any():
                continue
            crowded = (total[a:b][keep] > CROWDED).tobytes()
            if posted:
                docs, places = np.frombuffer(source[2], np.uint16)[keep], np.frombuffer(source[3], np.uint32)[keep]
                out.append((source[0], part, POSTINGS, None, docs.tobytes(), places.tobytes(), crowded))
            else:
                out.append((source[0], part, COUNTS, source[1], None, None, crowded))
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)]
    return pa.table(columns, ["block", "part", "kind", "keys", "docs", "places", "crowded"])


def _by_document(parts: int):
    """The places of a block's anchors that stay, by document, and which of them are crowded."""

    def rows(table: pa.Table) -> pa.Table:
        docs, places, crowds = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)], [np.zeros(0, bool)]
        told, told_crowded = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for _, part, kind, keys, doc, place, crowd in _rows(table):
            if kind == HEAD:
                own, prints = np.frombuffer(doc, np.int64), np.frombuffer(place, np.int64)
            elif kind == COUNTS:
                told.append(tokens.unpack_low(keys, KEY_BYTES) | np.uint64(part) << np.uint64(40))
                told_crowded.append(np.frombuffer(crowd, bool))
            else:
                docs.append(np.frombuffer(doc, np.uint16))
                places.append(np.frombuffer(place, np.uint32))
                if kind == POSTINGS:
                    crowds.append(np.frombuffer(crowd, bool))
                else:
                    waiting = len(docs) - 1
                    wanted = tokens.in_range(np.frombuffer(keys, np.uint64), parts)
                    crowds.append(np.zeros(len(wanted), bool))
        known, crowded = np.concatenate(told), np.concatenate(told_crowded)
        if len(wanted):  # every anchor that waits has its count
            order = np.argsort(known)
            crowds[waiting] = crowded[order][np.searchsorted(known[order], wanted)]
        doc, place, crowd = np.concatenate(docs), np.concatenate(places), np.concatenate(crowds)
        order = np.argsort(doc, kind="stable")
        doc, place, crowd = doc[order], place[order], crowd[order]
        at = np.flatnonzero(np.diff(doc.astype(np.int32), prepend=-1))
        ends = [*at[1:], len(doc)]
        alive = [place[a:b].tobytes() for a, b in zip(at, ends)]
        many = [place[a:b][crowd[a:b]].tobytes() for a, b in zip(at, ends)]
        return pa.table([
            pa.array(own[doc[at]]), pa.array(prints[doc[at]]), pa.array(alive, pa.binary()), pa.array(many, pa.binary()),
        ], ["id", "print", "alive", "crowded"])

    return rows


def _places(column: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Lists of packed positions in documents as sorted positions in the batch."""
    out = [
        np.frombuffer(packed, np.uint32).astype(np.int64) + first
        for lists, first in zip(column.to_pylist(), bounds)
        for packed in lists
    ]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _narrowed(
    names: Names, sums: np.ndarray, short: np.ndarray, least: np.ndarray, starts: np.ndarray, length: int
) -> np.ndarray:
    """Keys of strings with crowded anchors: the anchor and the bytes beside it, on the wider side.

    The anchor is the first place of the least name in the string, so equal strings get one key.
    """
    half, side = length // 2, length // 4
    place = np.full(len(starts), -1)
    for step in range(length - half + 1):
        hit = (place < 0) & (short[starts + step] == least[starts])
        place[hit] = step
    left = place >= length - half - place  # at least as many bytes before the anchor as after it
    at = starts + np.where(left, place - side, place + half)
    beside = (sums[at + side] - sums[at]) * names.inverse[at]
    return tokens.mix(least[starts] + tokens.mix(beside + left.astype(np.uint64)))


def _differing(data: np.ndarray, own: np.ndarray, lead: np.ndarray, width: np.ndarray):
    """Which bytes of the runs at ``own`` differ from those at ``lead``, run by run, and the runs' bounds."""
    bounds = np.concatenate([[0], np.cumsum(width)])
    at = np.arange(bounds[-1]) + np.repeat(own - bounds[:-1], width)
    return data[at] != data[at + np.repeat(lead - own, width)], bounds


def equal_strings(data: np.ndarray, own: np.ndarray, lead: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each ``own`` are those at its ``lead``.

    Where neighbours in ``own`` and ``lead`` go on together, a byte is compared once for all strings
    that hold it.
    """
    out = np.zeros(len(own), bool)
    if len(own) == 0:
        return out
    first = np.flatnonzero(np.append(True, (np.diff(own) != 1) | (np.diff(lead) != 1)))
    count = np.diff(np.append(first, len(own)))
    for a, b in tokens.pieces(np.concatenate([[0], np.cumsum(count + length - 1)]), CHUNK):
        begin, many = first[a:b], count[a:b]
        bad, bounds = _differing(data, own[begin], lead[begin], many + length - 1)
        faults = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        until = begin[0] + many.sum()
        at = np.arange(begin[0], until) + np.repeat(bounds[:-1] - begin, many)
        out[begin[0] : until] = faults[at + length] == faults[at]
    return out


def equal_runs(data: np.ndarray, own: np.ndarray, lead: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether each run of ``width`` bytes at ``own`` equals the one at its ``lead``."""
    if len(own) == 0:
        return np.zeros(0, bool)
    bad, bounds = _differing(data, own, lead, width)
    return np.add.reduceat(bad, bounds[:-1], dtype=np.int64) == 0


def _fragments(length: int, parts: int):
    """Second round, sending side: the strings of each anchor that stays, as fragments of text."""
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        turn = 7 * TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            part, name, lengths, own, prints, starts = (np.concatenate([h[c] for h in held]) for c in range(6))
            raw = np.concatenate([h[6] for h in held])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            # Equal fragments: the first in the corpus speaks for all, the others are repeats.
            order = np.lexsort((starts, prints, own, lengths, name))
            new = np.ones(len(order), bool)
            new[1:] = (name[order][1:] != name[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            # One that only has the name of its lead stays and is compared in the next step.
            new[~new] = ~equal_runs(raw, offsets[order[~new]], offsets[lead[~new]], lengths[order[~new]])
            later = (own[order] != own[lead]) | (prints[order] != prints[lead]) | (starts[order] != starts[lead])
            gone, kept = order[later & ~new], np.sort(order[new])
            kept = kept[np.argsort(part[kept], kind="stable")]
            at = np.flatnonzero(np.diff(part[kept].astype(np.int32), prepend=-1))
            out = []
            for a, b in zip(at, [*at[1:], len(kept)]):
                mine = kept[a:b]
                out.append((
                    int(part[mine[0]]), np.concatenate([raw[offsets[i] : offsets[i + 1]] for i in mine]).tobytes(),
                    lengths[mine].tobytes(), own[mine].tobytes(), prints[mine].tobytes(), starts[mine].tobytes(),
                    None, None, None, None,
                ))
            if len(gone):  # any range can pass them on; blocks take turns
                out.append((
                    turn % parts, None, None, None, None, None, own[gone].tobytes(),
                    prints[gone].tobytes(), starts[gone].tobytes(), (starts[gone] + lengths[gone]).tobytes(),
                ))
            held.clear()
            kinds = [pa.int32(), *[pa.binary()] * 9]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            return pa.record_batch(columns, FIELDS)

        for batch in batches:
            data, bounds = tokens.texts(batch.column(3))
            own, prints = tokens.ids(batch.column(1)), tokens.ids(batch.column(2))
            marks, crowds = _places(batch.column(4), bounds), _places(batch.column(5), bounds)
            for begin, end, inner in _chunks(bounds, length):
                a, b = np.searchsorted(marks, [begin, end - half + 1])
                if a == b or end - begin < length:
                    continue
                short, least = _minima(names, data[begin:end], inner - begin, length)
                alive = np.full(len(short), np.uint64(0xFFFFFFFFFFFFFFFF))
                at = marks[a:b] - begin
                alive[at] = short[at]
                open_ = (_sliding(np.minimum, alive, length - half + 1) == least) & (least != 0)
                sums = names.sums(data[begin:end])
                key = tokens.mix(least)
                c, d = np.searchsorted(crowds, [begin, end - half + 1])
                if c < d:
                    crowd = np.full(len(short), np.uint64(0xFFFFFFFFFFFFFFFF))
                    crowd[crowds[c:d] - begin] = short[crowds[c:d] - begin]
                    many = np.flatnonzero(
                        open_ & (_sliding(np.minimum, crowd, length - half + 1) == least)
                    )
                    key[many] = _narrowed(names, sums, short, least, many, length)
                edge = np.ones(len(least) + 1, bool)
                edge[1:-1] = (key[1:] != key[:-1]) | (open_[1:] != open_[:-1])
                runs = np.flatnonzero(edge)
                first, last = runs[:-1], runs[1:]
                keep = open_[first]
                first, last = first[keep], last[keep]
                more = (last - first - 1) // RUN  # long runs of one anchor go in steps
                if more.any():
                    step = np.arange(len(first)).repeat(more + 1)
                    inside = np.arange(len(step)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                    first = first[step] + inside * RUN
                    last = np.minimum(first + RUN, last[step])
                doc = np.searchsorted(bounds, begin + first, "right") - 1
                width = last - first + length - 1
                value = tokens.mix((sums[first + width] - sums[first]) * names.inverse[first])
                part = tokens.range_of(key[first], parts)
                take = np.concatenate([data[begin + f : begin + f + w] for f, w in zip(first, width)] or [data[:0]])
                held.append((part, value, width, own[doc], prints[doc], begin + first - bounds[doc], take))
                size += len(take)
                if size > FRAGMENT_BYTES:
                    yield flush()
                    size, turn = 0, turn + 1
        if size:
            yield flush()

    return rows


FIELDS = [field.strip().split()[0] for field in FRAGMENTS.split(",")]


def _doubled(length: int):
    """Second round: pair the ranks at each position and at the offset, sort, keep the repeats.

    Positions of one rank are compared with the first of them. Those that differ from it are ranked
    among themselves again, until each is the first of its string or equal to the first.
    """
    half = length // 2

    def rows(table: pa.Table) -> pa.Table:
        names = Names()
        gone: list[tuple[np.ndarray, ...]] = []
        packed = []
        for row in _rows(table):
            if row[1] is not None:
                lengths, own, prints, starts = (np.frombuffer(x, np.int64) for x in row[2:6])
                packed.append((np.frombuffer(row[1], np.uint8), lengths, own, prints, starts))
            else:
                gone.append(tuple(np.frombuffer(x, np.int64) for x in row[6:]))
        if packed:
            lengths, own, prints, starts = (np.concatenate([p[c] for p in packed]) for c in range(1, 5))
            raw = np.concatenate([p[0] for p in packed])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            order = np.lexsort((starts, prints, own))  # corpus order
            ranks, fragment, where = [], [], []
            i = 0
            while i < len(order):  # in steps, to bound the memory of the names
                j = i + max(1, int(np.searchsorted(np.cumsum(lengths[order[i:]]), CHUNK, "right")))
                mine = order[i:j]
                text = np.concatenate([raw[offsets[f] : offsets[f + 1]] for f in mine])
                short = names.of(names.sums(text), half)
                count = lengths[mine] - length + 1
                begin = np.concatenate([[0], np.cumsum(lengths[mine])])[:-1]
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(begin, count) + inside
                ranks.append(tokens.mix(tokens.mix(short[at]) + short[at + half]))
                fragment.append(np.repeat(mine.astype(np.int32), count))
                where.append(np.repeat(offsets[mine], count) + inside)
                i = j
            rank, fragment, where = np.concatenate(ranks), np.concatenate(fragment), np.concatenate(where)
            begin = starts - offsets[:-1]  # of a fragment in its document, less its begin here
            lead = np.arange(len(rank))
            left = lead.copy()
            while len(left):
                by = left[np.argsort(rank[left], kind="stable")]
                new = np.append(True, rank[by[1:]] != rank[by[:-1]])
                lead[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                left = left[lead[left] != left]
                same = equal_strings(raw, where[left], where[lead[left]], length)
                found, left = left[same], left[~same]
                f, g = fragment[found], fragment[lead[found]]
                at, first = begin[f] + where[found], begin[g] + where[lead[found]]
                later = (own[f] != own[g]) | (prints[f] != prints[g]) | (at != first)
                f, at = f[later], at[later]
                gone.append((own[f], prints[f], at, at + length))
        if gone:
            own, prints, begin, end = (np.concatenate([g[c] for g in gone]) for c in range(4))
        else:
            own = prints = begin = end = np.zeros(0, np.int64)
        order = np.lexsort((begin, prints, own))
        own, prints, begin, end = own[order], prints[order], begin[order], end[order]
        doc = np.flatnonzero(np.concatenate([[len(own) > 0], (own[1:] != own[:-1]) | (prints[1:] != prints[:-1])])[: len(own)])
        spans = []
        for a, b in zip(doc, [*doc[1:], len(own)]):
            spans.append(np.stack(merged(begin[a:b], end[a:b])).tobytes())
        return pa.table([pa.array(own[doc]), pa.array(prints[doc]), pa.array(spans, pa.binary())], ["id", "print", "gone"])

    return rows


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans, sorted by their begin, cover together."""
    if len(begin) == 0:
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the spans out of the texts."""
    for batch in batches:
        data, bounds = tokens.texts(batch.column(3))
        out = []
        for i, spans in enumerate(batch.column(4).to_pylist()):
            text = data[bounds[i] : bounds[i + 1]]
            pairs = [np.frombuffer(s, np.int64).reshape(2, -1) for s in spans or []]
            begin, end = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            order = np.argsort(begin, kind="stable")
            begin, end = merged(begin[order], end[order])
            edges = np.concatenate([[0], np.stack([begin, end], 1).ravel(), [len(text)]]).reshape(-1, 2)
            kept = b"".join(text[a:b].tobytes() for a, b in edges)
            out.append((
                len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(),
                kept if len(begin) else None, np.stack([begin, end], 1).tobytes() if len(begin) else None,
            ))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), *columns], names)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove every byte of a string of ``length`` bytes that starts earlier, too.

    One row per row of ``docs(doc_id, text, ...)``: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256`` of the remaining bytes, and where something was removed ``kept``,
    these bytes, and ``spans``, begin and end of the runs as pairs of 64-bit integers. Earlier means a
    smaller doc_id, or the same document and an earlier start. Strings are judged on the input and
    do not cross documents. ``length`` is even.

    A null text is empty; texts shorter than ``length`` stay whole. Rows without doc_id come last.
    Rows with one doc_id and different texts are different documents, ordered by a hash of the
    text; rows equal in both are one document, whose result each row gets. Other columns are not
    used, whatever their names. An empty table gives an empty result. Repeats are compared byte by
    byte; hashes only bring the strings together.
    """
    spark = docs.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 60_000 // SPREAD)
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(text).alias("print"), text.alias("text"),
    )
    anchors = rows.mapInArrow(_anchors(length, parts), ANCHORS)
    shared = anchors.groupBy("part").applyInArrow(_repeated, SHARED_SCHEMA)
    alive = materialise(shared.groupBy("block").applyInArrow(_by_document(parts), ALIVE))
    places = alive.groupBy("id", "print").agg(
        F.collect_list("alive").alias("alive"), F.collect_list("crowded").alias("crowded")
    )
    # Both joins read the texts by (id, print), so one exchange of the texts serves the two.
    open_ = rows.join(places.hint("shuffle_hash"), ["id", "print"]).select(
        "doc_id", "id", "print", "text", "alive", "crowded"
    )
    fragments = open_.mapInArrow(_fragments(length, parts * SPREAD), FRAGMENTS)
    gone = fragments.groupBy("part").applyInArrow(_doubled(length), GONE)
    gone = gone.groupBy("id", "print").agg(F.collect_list("gone").alias("gone"))
    ends = rows.join(gone.hint("shuffle_hash"), ["id", "print"], "left")
    return ends.select("doc_id", "id", "print", "text", "gone").mapInArrow(_cut, RESULT)
