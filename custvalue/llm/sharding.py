"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIRTUAL_NODES = 64  # per shard
CELLS = 1 << 14  # equal pieces of the ring, to find a point's arc by an equality join


def _point(*of: Column) -> Column:
    """A place on the ring, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*of), 1)


def _nodes(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """``(point, shard)`` of the virtual nodes in clockwise order: shards times virtual rows."""
    nodes = spark.range(shards * virtual).select(
        _point(F.lit("node"), (F.col("id") / virtual).cast("int"), F.col("id") % virtual).alias("point"),
        (F.col("id") / virtual).cast("int").alias("shard"),
    )
    return sorted((r.point, r.shard) for r in nodes.collect())


def _cells(spark: SparkSession, points: Sequence[int]) -> DataFrame:
    """Per cell of the ring, the nodes in it and the number of nodes before it."""
    width = (1 << 63) // CELLS
    inside: dict[int, list[int]] = {}
    for point in points:
        inside.setdefault(point // width, []).append(point)
    rows, before = [], 0
    for cell in range(CELLS):
        own = inside.get(cell, [])
        rows.append((cell, before, own))
        before += len(own)
    return spark.createDataFrame(rows, "cell long, before int, points array<long>")


def bounded_walk(
    demand: Sequence[int], owners: Sequence[int], room: Sequence[int]
) -> list[tuple[int, int, int, int, int]]:
    """Who takes which keys: ``(arc, first, last, shard, slot)`` with ranks ``first`` to ``last - 1``.

    ``demand`` counts the keys on the arc before each node, ``owners`` names the nodes' shards,
    ``room`` is each shard's bound. All keys knock at their own node; what a full shard turns away
    moves on to the next node clockwise, together, until it is let in. Within an arc, keys
    that come first in clockwise order are let in first. It works on counts, not on keys.
    """
    nodes = len(demand)
    free = list(room)
    used = [0] * len(room)
    done = [0] * nodes
    moving = [arc for arc in range(nodes) if demand[arc]]
    taken = []
    step = 0
    while moving:
        if step >= nodes:
            raise ValueError("the shards have less room than there are keys")
        for arc in moving:
            shard = owners[(arc + step) % nodes]
            count = min(free[shard], demand[arc] - done[arc])
            if count:
                taken.append((arc, done[arc], done[arc] + count, shard, used[shard]))
                done[arc] += count
                free[shard] -= count
                used[shard] += count
        moving = [arc for arc in moving if done[arc] < demand[arc]]
        step += 1
    return taken


def ring_shards(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """Every row of ``docs`` with a shard and a gapless slot in it; counts differ by one at most.

    A row's place on the ring comes from its doc_id, or from its text where the doc_id is null. Each
    shard owns ``virtual`` nodes and takes at most its even share of all rows: the first shards take
    one row more where the number does not divide. Overflowing keys go on clockwise (see
    :func:`bounded_walk`), so only keys near full shards leave the node of plain consistent hashing.
    ``home_shard`` is that node's shard.

    Size is the UTF-8 length of the text plus 16; a null text has none. Rows with equal ids are
    ordered by checksum and size, and rows equal in these are alike. Other columns of ``docs``
    are not used, whatever their names. An empty table gives an empty result. Only the key counts
    per arc and the slices of arcs, a few per virtual node, pass through the driver.
    """
    spark = docs.sparkSession
    nodes = _nodes(spark, shards, virtual)
    text = F.coalesce(F.col("text"), F.lit(""))
    point = F.when(F.col("doc_id").isNotNull(), _point(F.lit("key"), F.col("doc_id"))).otherwise(
        _point(F.lit("null"), text)
    )
    width = (1 << 63) // CELLS
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        point.alias("point"),
    ).withColumn("cell", F.floor(F.expr(f"point div {width}")))
    cells = _cells(spark, [p for p, _ in nodes])
    arc = (F.col("before") + F.size(F.filter("points", lambda p: p < F.col("point")))) % len(nodes)
    placed = rows.join(F.broadcast(cells), "cell").select(  # CELLS rows, shards * virtual points
        "doc_id", "size", "text_crc32", "point", arc.alias("arc")
    )
    counts = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    owners = [shard for _, shard in nodes]
    slices = bounded_walk([counts.get(a, 0) for a in range(len(nodes))], owners, room)
    table = spark.createDataFrame(
        [(a, first, last, owners[a], s, slot) for a, first, last, s, slot in slices],
        "arc int, first long, last long, home_shard int, shard int, slot_from long",
    )
    order = Window.partitionBy("arc").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    joined = ranked.join(F.broadcast(table).withColumnRenamed("arc", "own"), (F.col("arc") == F.col("own")) & inside)
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot_from") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
