"""Exact order statistics by radix histograms, without sorting or gathering a group in one task.

``F.median`` and a global ``row_number`` hold a whole group in one task. Here each value becomes a 64-bit
key in the same order, and a round counts rows by the next ``DIGIT_BITS`` bits of the key, per group. The
running count over these buckets tells in which bucket each wanted rank lies, and only its rows go into the
next round. Four rounds see all bits; as soon as the wanted buckets hold few rows, one last round takes all
remaining bits at once. Every round is an aggregate that folds before its shuffle, and what meets in one
task are the counts of a group, never its rows: at most ``BUCKETS`` per group and wanted rank.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.materialise import materialise

KEY_BITS = 64
DIGIT_BITS = 16
BUCKETS = 1 << DIGIT_BITS
# Per-group rows go to the other side by broadcast up to this many bytes, by shuffle beyond.
BROADCAST_BYTES = 8 << 20
BRACKET_BYTES = 256

# The layout of a double: its exponent's range and bias, and the bits of its fraction.
FRACTION = float(1 << 52)
BIAS = 1023
LEAST_EXPONENT = -1022

Rank = Callable[[Column], Column]


def with_ordered_key(df: DataFrame, value: str, out_col: str) -> DataFrame:
    """Add a value as a long in the same order; equal values, and only those, have equal keys.

    A whole number is its own key. A double's key is its exponent followed by its fraction, found by exact
    scaling with powers of two, and negative for a negative number. Minus zero equals zero; not-a-number
    comes last. The steps are projections of their own, so that each is computed once a row.
    """
    kind, whole = df.schema[value].dataType, df.columns
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(out_col, F.col(value).cast("long"))
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError(f"no order statistics of {kind.simpleString()} values")
    size, near, scaled = F.col("_size"), F.col("_near"), F.col("_scaled")
    limited = F.greatest(F.least(F.floor(F.log2(size)), F.lit(BIAS)), F.lit(LEAST_EXPONENT)).cast("int")
    # The logarithm may be one off beside a power of two; the scaled number then tells.
    up, down = scaled >= 2, (scaled < 1) & (near > LEAST_EXPONENT)
    exponent = near + F.when(up, 1).when(down, -1).otherwise(0)
    fraction = F.when(up, scaled / 2).when(down, scaled * 2).otherwise(scaled) - 1
    bits = (exponent + BIAS).cast("long") * F.lit(1 << 52) + (fraction * F.lit(FRACTION)).cast("long")
    number, infinity = F.col(value).cast("double"), F.lit(float("inf"))
    finite = (F.abs(number) > 0) & (F.abs(number) < infinity)  # not-a-number is above infinity
    key = (
        F.when(F.isnan(number), F.lit((1 << 63) - 1))
        .when(number == 0, F.lit(0).cast("long"))
        .when(number == infinity, F.lit((2 * BIAS + 1) << 52))
        .when(number == -infinity, F.lit(-((2 * BIAS + 1) << 52)))
        .when(number < 0, -F.col("_bits"))
        .otherwise(F.col("_bits"))
    )
    return (
        df.select(*whole, F.when(finite, F.abs(number)).otherwise(F.lit(1.0)).alias("_size"))
        .select("*", limited.alias("_near"))
        .select("*", (size * F.pow(F.lit(2.0), -near)).alias("_scaled"))
        .select(*whole, bits.alias("_bits"))
        .select(*whole, key.alias(out_col))
    )


def order_statistics(
    rows: DataFrame,
    value: str,
    ranks: dict[str, Rank],
    by: Sequence[str],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The values at given 1-based ascending ranks, one row per ``by`` group.

    ``ranks`` maps an output column to a function of the group's row count; ranks past the end
    mean the last row, ranks below 1 give null. Beside each output column ``c`` come ``c_rank``
    (the rank after that), ``c_below`` and ``c_equal`` (rows smaller than and equal to the value).
    The ranks of one call may lie anywhere in a group; all are found in the same rounds. ``extra`` are
    aggregates that are returned too, from a pass of their own.

    ``rows`` is read two to four times and must give the same rows each time: hand in a materialised
    or written one. ``value`` and the ``by`` columns must hold no nulls.
    """
    by, names = list(by), list(ranks)
    keyed = with_ordered_key(rows.select(*by, F.col(value).alias("_value")), "_value", "_key")

    shift = KEY_BITS - DIGIT_BITS
    counted = keyed.groupBy(*by, F.shiftright("_key", shift).alias("_prefix")).agg(*_counts())
    running = _running(counted, by, Window.partitionBy(*by).orderBy("_prefix"))
    whole = F.sum("_rows").over(Window.partitionBy(*by))
    wanted = {f"{c}_rank": F.least(rank(F.col("_n")), F.col("_n")).cast("long") for c, rank in ranks.items()}
    placed = running.withColumn("_n", whole).withColumns(wanted)
    keys = [*by, *wanted]
    found = materialise(placed.groupBy(*keys).agg(*[_at_rank(c, F.lit(True)) for c in names]))
    groups, most = _left(found, names)
    while groups and shift:
        step = DIGIT_BITS if most > BUCKETS else shift
        found = _narrowed(keyed, found, by, keys, names, groups, shift, shift - step)
        shift -= step
        if shift:
            found = materialise(found)
            groups, most = _left(found, names)
    result = found.select(*by, *[column for c in names for column in _unpacked(c)])
    return result.join(rows.groupBy(*by).agg(*extra), by) if extra else result


def _counts() -> list[Column]:
    """Rows of a bucket, and its value if it has only one."""
    return [F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_value")]


def _running(counted: DataFrame, by: list[str], in_order) -> DataFrame:
    upto = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_upto", upto)


def _left(found: DataFrame, names: list[str]) -> tuple[int, int]:
    """How many groups there are, and the most rows that a bucket with a wanted rank holds."""
    in_bucket = F.max(F.greatest(*[F.col(c)["rows"] for c in names], F.lit(0)))
    groups, most = found.agg(F.count(F.lit(1)), in_bucket).first()
    return groups, most or 0


def _narrowed(
    keyed: DataFrame,
    found: DataFrame,
    by: list[str],
    keys: list[str],
    names: list[str],
    groups: int,
    shift: int,
    rest: int,
) -> DataFrame:
    """Each rank's bucket by the bits above ``rest``, given that by the bits above ``shift``.

    Only rows of a bucket with a wanted rank are counted. Their running counts start at the rows that lie
    below the bucket.
    """
    limits = found.select(*keys, *[column for c in names for column in _start(c)])
    if groups * BRACKET_BYTES * len(names) <= BROADCAST_BYTES:
        limits = F.broadcast(limits)
    prefix = F.shiftright("_key", shift)
    inside = reduce(or_, [F.col(f"_{c}_prefix") == prefix for c in names])
    starts = [F.first(f"_{c}_{part}").alias(f"_{c}_{part}") for c in names for part in ("prefix", "below")]
    counted = (
        keyed.join(limits, by)
        .filter(F.coalesce(inside, F.lit(False)))
        .groupBy(*keys, prefix.alias("_above"), F.shiftright("_key", rest).alias("_prefix"))
        .agg(*_counts(), *starts)
    )
    running = _running(counted, by, Window.partitionBy(*keys, "_above").orderBy("_prefix"))
    hits = [_at_rank(c, F.col("_above") == F.col(f"_{c}_prefix"), F.col(f"_{c}_below")) for c in names]
    narrow = running.groupBy(*keys).agg(*hits)
    # A group that wants only ranks below 1 has no rows left.
    lost = found.select(*keys).join(narrow, keys, "left")
    return lost.select(*keys, *names)


def _start(name: str) -> list[Column]:
    """A rank's bucket so far and the rows below it, under names of their own."""
    hit = F.col(name)
    return [hit["prefix"].alias(f"_{name}_prefix"), (hit["upto"] - hit["rows"]).alias(f"_{name}_below")]


def _at_rank(name: str, here: Column, below: Column | None = None) -> Column:
    """The first bucket whose running count reaches the rank, with its counts; null for a rank below 1."""
    upto = F.col("_upto") if below is None else F.col("_upto") + below
    rank = F.col(f"{name}_rank")
    row = F.struct(
        upto.alias("upto"), F.col("_prefix").alias("prefix"), F.col("_rows").alias("rows"), F.col("_value").alias("value")
    )
    return F.min(F.when(here & (rank >= 1) & (upto >= rank), row)).alias(name)


def _unpacked(name: str) -> list[Column]:
    """Result columns of one rank."""
    hit = F.col(name)
    return [
        hit["value"].alias(name),
        F.col(f"{name}_rank"),
        (hit["upto"] - hit["rows"]).alias(f"{name}_below"),
        hit["rows"].alias(f"{name}_equal"),
    ]


def median(
    rows: DataFrame, value: str, out_col: str, by: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Exact median per group: the middle value, or the mean of the two middle ones."""
    middle = order_statistics(
        rows,
        value,
        {"_lower": lambda n: F.floor((n + 1) / 2), "_upper": lambda n: F.floor(n / 2) + 1},
        by,
        extra,
    )
    parts = [c for c in middle.columns if c.startswith(("_lower", "_upper"))]
    return middle.withColumn(out_col, (F.col("_lower") + F.col("_upper")) / 2).drop(*parts)
