"""Typed and de-duplicated inputs.

The three column sets matter: columns are dropped before nulls and copies are removed, so each
set gives a different number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.materialise import materialise

ALL_COLUMNS = ("ctc_id", "order_date", "source", "location", "value")
NO_SOURCE = ("ctc_id", "order_date", "location", "value")
NO_SOURCE_NO_LOCATION = ("ctc_id", "order_date", "value")


def type_transactions(raw: DataFrame) -> DataFrame:
    """Cut ``order_date`` (text or timestamp) down to its day."""
    return raw.withColumn("order_date", F.col("order_date").cast("date"))


# Pairs of source and location that are numbered; beyond them a row lists its pairs by name.
MAX_PLACES = 1_024
WORD_BITS = 63

Place = tuple[str | None, str | None]


@dataclass(frozen=True)
class NestedVisits:
    """All three distinct sets in one table: a row per customer, day and value with its places.

    ``table`` has the columns of the narrowest set and ``places``, the distinct pairs of source and
    location (either may be null): their numbers in ``known``, or structs if there are too many to number.
    It takes one shuffle; the wider sets unfold from its rows without another. Store it
    (:func:`nested_distinct` gives a plan) before several sets are read.
    """

    table: DataFrame
    known: tuple[Place, ...] | None

    def rows(self, columns: Sequence[str]) -> DataFrame:
        """What :func:`distinct_rows` of the transactions gives."""
        known = {ALL_COLUMNS: self._full, NO_SOURCE: self._places, NO_SOURCE_NO_LOCATION: self._days}
        return known[tuple(columns)]()

    def filter(self, condition: Column) -> NestedVisits:
        """Only visits that meet a condition on customer, day and value."""
        return NestedVisits(self.table.filter(condition), self.known)

    def stored(self) -> NestedVisits:
        """The same from a written table."""
        return NestedVisits(materialise(self.table), self.known)

    def named(self) -> NestedVisits:
        """The same with places by name."""
        if self.known is None:
            return self
        lists = zip(("source", "location"), self._names())
        place = F.transform("places", lambda number: F.struct(*[F.get(names, number).alias(name) for name, names in lists]))
        return NestedVisits(self.table.withColumn("places", place), None)

    def by_location(self) -> tuple[DataFrame, Column]:
        """The rows of :data:`NO_SOURCE` with a short key ``at`` instead of the location, and the key's name."""
        if self.known is None:
            return self._places().withColumnRenamed("location", "at"), F.col("at")
        names = sorted({location for _, location in self.known if location is not None})
        number = {name: i for i, name in enumerate(names)}
        numbers = F.lit([number.get(location) for _, location in self.known] or [None]).cast("array<int>")
        several = F.array_distinct(F.transform("places", lambda place: F.get(numbers, place)))
        one = F.array(F.get(numbers, F.get("places", F.lit(0))))
        each = self.table.withColumn("at", F.explode(F.when(F.size("places") == 1, one).otherwise(several)))
        found = each.where(F.col("at").isNotNull()).select("ctc_id", "order_date", "value", "at")
        return found, F.get(F.lit(names or [None]).cast("array<string>"), F.col("at"))

    def by_place(self) -> tuple[DataFrame, dict[str, Column]]:
        """The rows of :data:`ALL_COLUMNS` with a short key ``at`` instead of source and location, and their names."""
        if self.known is None:
            place = F.struct("source", "location").alias("at")
            names = {name: F.col("at")[name] for name in ("source", "location")}
            return self._full().select("ctc_id", "order_date", "value", place), names
        whole = F.lit([None not in place for place in self.known] or [False])
        each = self.table.select("ctc_id", "order_date", "value", F.explode("places").alias("at"))
        names = dict(zip(("source", "location"), [F.get(names, F.col("at")) for names in self._names()]))
        return each.where(F.get(whole, F.col("at"))), names

    def _names(self) -> list[Column]:
        """The sources and the locations of the numbered places."""
        both = zip(*self.known) if self.known else ([None], [None])
        return [F.lit(list(names)).cast("array<string>") for names in both]

    def _days(self) -> DataFrame:
        return self.table.select(*NO_SOURCE_NO_LOCATION)

    def _places(self) -> DataFrame:
        if self.known is None:
            named = F.transform("places", lambda p: p["location"])
        else:
            locations = F.lit([location for _, location in self.known] or [None]).cast("array<string>")
            named = F.transform("places", lambda number: F.get(locations, number))
        each = self.table.withColumn("location", F.explode(F.array_distinct(F.array_compact(named))))
        return each.select(*NO_SOURCE)

    def _full(self) -> DataFrame:
        each = self.table.withColumn("place", F.explode("places"))
        if self.known is None:
            named = {name: F.col("place")[name] for name in ("source", "location")}
        else:
            lists = zip(("source", "location"), self._names())
            named = {name: F.get(names, F.col("place")) for name, names in lists}
        return each.withColumns(named).select(*ALL_COLUMNS).na.drop("any", subset=["source", "location"])


def seen_places(tx: DataFrame) -> DataFrame:
    """A row per pair of source and location with its latest ``order_date``, before any cleaning.

    ``kept`` tells whether a row of the pair has customer, day and value. One pass over the raw transactions
    for what three reports ask of all of them: the as-of date, the locations and the pairs to number.
    """
    kept = F.lit(True)
    for name in NO_SOURCE_NO_LOCATION:
        kept &= F.col(name).isNotNull()
        if isinstance(tx.schema[name].dataType, (T.DoubleType, T.FloatType)):
            kept &= ~F.isnan(name)
    latest = F.max(F.col("order_date").cast("date")).alias("order_date")
    return tx.groupBy("source", "location").agg(latest, F.max(kept).alias("kept"))


def nested_distinct(
    tx: DataFrame, max_places: int = MAX_PLACES, seen: DataFrame | None = None
) -> NestedVisits:
    """The three distinct sets from one exchange.

    The shuffle hashes customer, day and value, which all three sets have, so equal rows of each set meet.
    A pair of source and location is a bit in one of a few longs, so copies fold map-side into numbers of
    fixed size; a pass over the two columns finds the pairs first, unless ``seen`` has them, the stored
    :func:`seen_places` of ``tx``. With more than ``max_places`` pairs the rows gather sets of names instead;
    0 asks for that without the first pass.
    """
    kept = tx.select(*ALL_COLUMNS).na.drop("any", subset=list(NO_SOURCE_NO_LOCATION))
    pairs = []
    if max_places:
        found = kept.select("source", "location").distinct() if seen is None else seen.where("kept").select("source", "location")
        pairs = found.limit(max_places + 1).collect()
    days = kept.groupBy(*NO_SOURCE_NO_LOCATION)
    if not max_places or len(pairs) > max_places:
        return NestedVisits(days.agg(F.collect_set(F.struct("source", "location")).alias("places")), None)
    known = tuple(sorted(map(tuple, pairs), key=lambda p: [(name is not None, name or "") for name in p]))
    numbered = tx.sparkSession.createDataFrame(
        [(s, p, i // WORD_BITS, 1 << i % WORD_BITS) for i, (s, p) in enumerate(known)],
        "_source string, _location string, word int, bit long",
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("location").eqNullSafe(F.col("_location"))
    coded = kept.join(F.broadcast(numbered), same).groupBy(*NO_SOURCE_NO_LOCATION)
    words = range(max(1, -(-len(known) // WORD_BITS)))
    bits = coded.agg(
        *[F.bit_or(F.when(F.col("word") == w, F.col("bit"))).alias(f"word_{w}") for w in words]
    )
    places = F.concat(*[_set_bits(f"word_{w}", w * WORD_BITS) for w in words])
    return NestedVisits(bits.select(*NO_SOURCE_NO_LOCATION, places.alias("places")), known)


def _set_bits(word: str, first: int) -> Column:
    """The places of the bits that are set in a long, counted from ``first``; none for a null."""
    start = F.struct(F.col(word).alias("rest"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        place = F.bit_count(rest.bitwiseAND(-rest) - 1) + first
        return F.struct(
            rest.bitwiseAND(rest - 1).alias("rest"), F.array_append(state["found"], place).alias("found")
        )

    turns = F.sequence(F.lit(1), F.bit_count(F.col(word)))
    found = F.aggregate(turns, start, step, lambda state: state["found"])
    none, one = F.array().cast("array<int>"), F.array(F.bit_count(F.col(word) - 1) + first)
    return F.when(F.col(word).isNull(), none).when(F.bit_count(F.col(word)) == 1, one).otherwise(found)


def distinct_rows(tx: DataFrame | NestedVisits, columns: Sequence[str] = ALL_COLUMNS) -> DataFrame:
    """Rows of ``columns`` without nulls and without copies.

    The shuffle hashes all the columns after a map-side pass, so neither a busy customer nor a
    large group of copies lands in one task. Of nested visits the rows are unfolded instead.
    """
    if isinstance(tx, NestedVisits):
        return tx.rows(columns)
    return tx.select(*columns).na.drop("any").dropDuplicates()


def clean_contacts(contacts: DataFrame) -> DataFrame:
    """Distinct (ctc_id, age_category) pairs; nulls in other contact columns do not matter."""
    return distinct_rows(contacts, ("ctc_id", "age_category"))


def as_of(tx: DataFrame) -> DataFrame:
    """One row with the latest order date of the raw, uncleaned transactions."""
    return tx.agg(F.max(F.col("order_date").cast("date")).alias("as_of"))


def as_of_date(tx: DataFrame) -> Column:
    """The as-of date as a scalar subquery, for use inside another frame's expressions."""
    return as_of(tx).scalar()
