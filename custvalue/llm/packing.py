"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP_PIECES = 20_000  # pieces that are packed together; only this many meet in one task
SPACES = "[\\x20\\x09-\\x0D]+"


def bin_cost(capacity: int) -> float:
    """What a training step pays for a sequence: linear work plus attention's quadratic share."""
    return capacity * (1 + capacity / 16_384)


def best_fit(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final capacity of each bin.

    Pieces are placed from the longest to the shortest, each into the open bin that it leaves with
    the least room. If none has room, a bin opens. Its capacity is the one that costs least per
    token that it can come to hold: the piece itself and the still unplaced pieces that fit beside
    it. At the end each bin shrinks to the smallest capacity that holds its contents.
    """
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    capacities = sorted(capacities)
    left = np.bincount(sizes, minlength=capacities[-1] + 1)  # unplaced pieces by length
    totals = np.cumsum(left * np.arange(len(left)))
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    room: dict[int, list[int]] = {}  # open bins by the room that is left
    rooms: list[int] = []
    for i in order:
        length = int(sizes[i])
        at = bisect_left(rooms, length)
        if at < len(rooms):
            free = rooms[at]
            chosen = room[free].pop()
            if not room[free]:
                del room[free], rooms[at]
        else:
            # Longer pieces are placed, so the totals up to the gap hold only pieces to come.
            def rate(capacity: int) -> float:
                gap = min(capacity - length, length)  # noqa: B023
                return bin_cost(capacity) / (length + min(capacity - length, int(totals[gap])))  # noqa: B023

            free = min((c for c in capacities if c >= length), key=rate)
            chosen = len(fill)
            fill.append(0)
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += length
        free -= length
        if free:
            if free not in room:
                insort(rooms, free)
                room[free] = []
            room[free].append(chosen)
    final = [capacities[bisect_left(capacities, used)] for used in fill]
    return bins, offsets, final


def n_tokens(text: str = "text") -> Column:
    """Words between white space, and one end mark. A null or empty text has only the mark."""
    solid = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", F.lit(0)).otherwise(F.size(F.split(solid, SPACES))) + 1


def pack(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    length: Column | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Where each piece of each row of ``docs`` goes: one row per piece.

    ``doc_id, piece, start, length, bin_id, bin_capacity, bin_offset``: tokens ``start`` to ``start +
    length - 1`` of the document lie at ``bin_offset`` of the bin. ``length`` gives the tokens of a
    row (default: words plus an end mark). A document longer than the largest capacity is cut
    into pieces of that capacity and a rest, so every token is placed once. Bins hold pieces of one
    group; groups are dealt at random and hold about ``group_pieces``, whatever the data. A null
    or empty text is one token. Repeated rows and null ids are packed like others; other columns are
    not used, whatever their names. An empty table gives an empty result.
    """
    largest = max(capacities)
    rows = docs.select("doc_id", (n_tokens() if length is None else length).cast("long").alias("total"))
    cut = rows.where("total > 0").select(
        "doc_id", "total", F.explode(F.sequence(F.lit(0), F.expr(f"(total - 1) div {largest}"))).alias("piece")
    )
    # Row numbers, not ids: a repeated id must not fill one group.
    cut = cut.select(
        "doc_id", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * largest).cast("long").alias("start"),
        F.least(F.col("total") - F.col("piece") * largest, F.lit(largest)).cast("int").alias("length"),
        F.monotonically_increasing_id().alias("row"),
    )
    # A token takes two bytes with its separator, so this bounds the pieces without splitting text.
    if length is None:
        bound = F.lit(1) + F.expr(f"octet_length(text) div {2 * largest}")
    else:
        bound = F.expr("1") + F.floor(length / largest)
    total = docs.agg(F.sum(F.coalesce(bound, F.lit(1)))).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    cut = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    sizes = tuple(sorted(capacities))

    def packed(group: pa.Table) -> pa.Table:
        keys = [("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]
        group = group.sort_by(keys)
        bins, offsets, final = best_fit(group["length"].to_numpy(), sizes)
        number = np.asarray(bins, np.int64)
        return pa.table({
            "doc_id": group["doc_id"], "piece": group["piece"], "start": group["start"],
            "length": group["length"],
            "bin_id": (group["group"].to_numpy() << 32) + number,
            "bin_capacity": np.asarray(final, np.int32)[number],
            "bin_offset": np.asarray(offsets, np.int32),
        })

    schema = "doc_id long, piece int, start long, length int, bin_id long, bin_capacity int, bin_offset int"
    return cut.groupBy("group").applyInArrow(packed, schema)
