"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, the source's target over its
size. The whole part is taken as it is. The fractions are rounded in pairs: words move at random from
one document of a pair to the other until one of the two has a whole number of copies. A pair's words
stay the same in sum, and each document's words in expectation. The documents of a source are rounded
in bounded leaves, each of which leaves at most one fraction; these residuals are rounded again in the
nodes of a tree until a source has one, and of that document only the words that are left are taken.
So a source's words miss its target by the last rounding to a whole word only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm.tokens import mix as spread_bits

WEIGHTS = (5, 2, 1)
MOST = 3  # times that a document may be taken at most
LEAF_ROWS = 1_024  # documents that are rounded together
FAN = 256  # residuals that are rounded together in a node of the tree
WORD = r"[^\x20\x09-\x0D]+"

ROUNDED = "doc_id long, source string, size long, source_no long, leaf long, share double, copy int"
RESIDUALS = "source_no long, leaf long, node long, size long, print long, share double, copy int"


def pivotal(sizes: np.ndarray, shares: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Shares of which at most one is still a fraction, with the same sum of ``sizes * shares``.

    Rounds pair what is fractional two by two, in the order given. In a pair, either the first gains
    what the second can give or what fills it, or the other way round; the odds are such that the
    expectation of both stays. ``prints`` and the round's number make the random numbers, so equal
    input gives equal output. A document without words is never a fraction: its share becomes 0.
    """
    sizes, shares = sizes.astype(np.float64), shares.copy()
    shares[sizes == 0] = 0.0
    live = np.flatnonzero((shares > 0) & (shares < 1))
    turn = 0
    while len(live) > 1:
        odd = live[len(live) // 2 * 2 :]
        i, j = live[0 : len(live) - len(odd) : 2], live[1 : len(live) : 2]
        a, b, p, q = sizes[i], sizes[j], shares[i], shares[j]
        rise = np.minimum(a * (1 - p), b * q)  # words that can go from j to i
        fall = np.minimum(a * p, b * (1 - q))
        up = _uniform(prints[i], prints[j], turn) * (rise + fall) < fall
        moved = np.where(up, rise, -fall)
        # Which of the two becomes whole is told by the limits; the other takes up the words.
        first = np.where(up, a * (1 - p) <= b * q, a * p <= b * (1 - q))
        shares[i] = np.where(first, np.where(up, 1.0, 0.0), np.clip(p + moved / a, 0, 1))
        shares[j] = np.where(first, np.clip(q - moved / b, 0, 1), np.where(up, 0.0, 1.0))
        live = np.concatenate([np.stack([i, j], axis=1).ravel(), odd])
        live = live[(shares[live] > 0) & (shares[live] < 1)]
        turn += 1
    return shares


def _uniform(first: np.ndarray, second: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) from two 64-bit prints each and the turn."""
    both = spread_bits(first.view(np.uint64) + np.uint64(turn + 1)) ^ second.view(np.uint64)
    return (spread_bits(both) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _numbers(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind)


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by size, so that like meets like, and their shares after rounding."""
    table = table.sort_by([("size", "ascending"), ("print", "ascending")])
    shares = pivotal(_numbers(table, "size"), _numbers(table, "share", np.float64), _numbers(table, "print"))
    return table, shares


def _copies(shares: np.ndarray) -> pa.Array:
    """1 or 0 where a share is whole, null where it is still a fraction."""
    whole = (shares == 0) | (shares == 1)
    return pa.array(np.where(shares == 1, 1, 0), pa.int32(), mask=~whole)


def _leaf(table: pa.Table) -> pa.Table:
    table, shares = _ordered(table)
    kept = table.select(["doc_id", "source", "size", "source_no", "leaf", "print"])
    return kept.append_column("share", pa.array(shares)).append_column("copy", _copies(shares))


def _node(table: pa.Table) -> pa.Table:
    table, shares = _ordered(table)
    kept = table.select(["source_no", "leaf", "node", "size", "print"])
    return kept.append_column("share", pa.array(shares)).append_column("copy", _copies(shares))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST
) -> DataFrame:
    """``source, source_no, rows, source_size, target`` of a table ``source, size``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and divide ``share``
    of all words. A target stops at ``most`` times its source's size; what is over goes to the others by
    weight until none is above. The capped sources are the first ones by ``cap / weight``, so running
    sums give the level at which the rest stands. The windows run over one row per source.
    """
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.asc_nulls_last("source"))
    number = (F.row_number().over(by_name) - 1).cast("long")
    turn = F.lit([float(w) for w in weights])
    numbered = sums.withColumn("source_no", number)
    weighed = numbered.withColumns(
        {
            "weight": F.get(turn, (F.col("source_no") % len(weights)).cast("int")),
            "cap": F.lit(float(most)) * F.col("source_size"),
            "words": F.lit(float(share)) * F.sum("source_size").over(everything),
        }
    )
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)

    def rest(total: Column, part: str) -> Column:
        return total - F.coalesce(F.sum(part).over(before), F.lit(0.0))

    level = rest(F.col("words"), "cap") / rest(F.sum("weight").over(everything), "weight")
    leveled = weighed.withColumns({"level": level, "position": F.row_number().over(by_fill)})
    open_ = F.col("cap") / F.col("weight") >= F.col("level")
    stands = F.min_by("level", F.when(open_, F.col("position"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * stands, F.col("cap")))
    return leveled.select("source", "source_no", "rows", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    most: float = MOST,
    leaf_rows: int = LEAF_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """How many words of every document a mix of the sources takes.

    Returns ``doc_id, source, size, source_size, target, copies, cut, taken``: the document's words, those
    of its source and the source's target; the whole copies, the words taken of one more copy (more
    than none for one document of a source at most), and the words of both. ``most`` must be whole.

    A null or empty text has size 0 and is never taken; a source of such texts only has the target 0.
    A null source is a source of its own. Equal rows and equal ids count each by itself; a null id
    stays. Other columns are ignored. The random numbers come from ids and texts, so reruns agree.

    A leaf holds about ``leaf_rows`` documents of one source, spread by a hash of id and text, so the
    largest source has most leaves. A node of the tree holds the residuals of ``fan`` leaves at most.
    """
    if most != int(most):
        raise ValueError("a document can be taken a whole number of times at most")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", text, "source").alias("print"),
    )
    sized = materialise(sized)
    sources = materialise(source_targets(sized, weights, share, most))
    rate = F.least(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    rates = sources.select("*", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("fraction"))
    slim = rates.select(
        F.col("source").alias("_source"), "source_no", F.col("fraction").alias("share"),
        F.ceil(F.col("rows") / leaf_rows).cast("long").alias("leaves"),
    )
    # One row per source on the other side; Spark's size check decides on a broadcast.
    dealt = sized.join(slim, sized["source"].eqNullSafe(slim["_source"]))
    dealt = dealt.withColumn("leaf", F.pmod(F.xxhash64("print"), "leaves")).drop("leaves", "_source")
    rounded = dealt.groupBy("source_no", "leaf").applyInArrow(_leaf, ROUNDED + ", print long")
    rounded = materialise(rounded)
    ends = _tree(rounded, fan)
    found = rounded.join(ends, (F.col("copy").isNull()) & (rounded["source_no"] == ends["end_source"]) & (rounded["leaf"] == ends["end_leaf"]), "left")
    known = rates.select(F.col("source_no").alias("no"), "source_size", "target", "base")
    copies = F.col("base") + F.coalesce("copy", "end_copy", F.lit(0))
    last = F.col("copy").isNull() & F.col("end_copy").isNull()
    cut = F.when(last, F.rint(F.coalesce("end_share", F.lit(0.0)) * F.col("size"))).otherwise(0).cast("long")
    return (
        found.join(known, F.col("source_no") == F.col("no"))
        .withColumns({"copies": copies.cast("long"), "cut": cut})
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("cut"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "cut", "taken")
    )


def _tree(rounded: DataFrame, fan: int) -> DataFrame:
    """What becomes of each leaf's residual: ``end_source, end_leaf, end_copy, end_share``.

    A level deals the residuals of ``fan`` neighbouring nodes to one node above them. Each level is a
    written table of one row per residual, and only what is still a fraction goes up.
    """
    level = rounded.where(F.col("copy").isNull())
    level = level.select("source_no", "leaf", F.col("leaf").alias("node"), "size", "print", "share")
    ends = []
    top = level.agg(F.max("node")).first()[0]
    while top:  # null without residuals, 0 once every source is in its first node
        level = level.withColumn("node", F.floor(F.col("node") / fan))
        done = materialise(level.groupBy("source_no", "node").applyInArrow(_node, RESIDUALS))
        ends.append(done.where(F.col("copy").isNotNull()))
        level = done.where(F.col("copy").isNull()).drop("copy")
        top //= fan
    ends.append(level.withColumn("copy", F.lit(None).cast("int")))
    found = [
        e.select(
            F.col("source_no").alias("end_source"), F.col("leaf").alias("end_leaf"),
            F.col("copy").alias("end_copy"), F.col("share").alias("end_share"),
        )
        for e in ends
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
