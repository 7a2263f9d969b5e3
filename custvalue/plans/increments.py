"""Visits and features that grow by new transactions, without reading all old ones again.

The state of all transactions so far is two tables. *Visits* are the nested distinct visits, in a folder per
month: equal rows have one date, so only the months of new rows can hold their copies. *Features* are what the
visit features fold to, a row per customer and location with count, sum, first and last day, in a folder per
bucket of customers. New rows are compared with the visits of their months, and what is really new is merged
into the features of the buckets that it touches.

Each update writes the touched months and buckets into a folder of its own, and a list, written last, of the
update that holds each month and bucket. So a failed update changes nothing, a reader sees one state as a
whole, and what is not touched is neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.dates import DateLike, as_date
from custvalue.functions.files import children, exists, remove
from custvalue.functions.materialise import materialise, scratch
from custvalue.operators.cleaning import (
    NO_SOURCE,
    NO_SOURCE_NO_LOCATION,
    NestedVisits,
    as_of,
    nested_distinct,
    seen_places,
)
from custvalue.operators.features import features_of
from custvalue.operators.overview import locations

BUCKETS = 256
VISITS, FEATURES, LOCATIONS, LISTS = "visits", "features", "locations", "lists"
MONTH, BUCKET = "month", "bucket"
KEY = ("ctc_id", "location")


@dataclass(frozen=True)
class State:
    """Which update holds each month's visits and each bucket's features, and all updates so far."""

    as_of: str | None = None
    buckets: int = BUCKETS
    months: dict[str, str] = field(default_factory=dict)
    features: dict[str, str] = field(default_factory=dict)
    updates: list[str] = field(default_factory=list)


def load_state(spark: SparkSession, path: str) -> State:
    """The latest state under ``path``; an empty one if there is none."""
    lists = [name for name in children(spark, f"{path}/{LISTS}") if exists(spark, f"{path}/{LISTS}/{name}/_SUCCESS")]
    if not lists:
        return State()
    return State(**json.loads(spark.read.parquet(f"{path}/{LISTS}/{lists[-1]}").first()["state"]))


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def _bucket(buckets: int) -> Column:
    """Customers by hash; a busy customer's rows are folded before they get here."""
    return F.pmod(F.xxhash64("ctc_id"), F.lit(buckets)).cast("int")


def _folds(merge: bool) -> list[Column]:
    """What the features need of distinct visits, or of such parts."""
    if merge:
        count, total, days = F.sum("visits"), F.sum("total"), ("first_day", "last_day")
    else:
        count, total, days = F.count(F.lit(1)), F.sum("value"), ("order_date", "order_date")
    return [
        count.alias("visits"), total.alias("total"),
        F.min(days[0]).alias("first_day"), F.max(days[1]).alias("last_day"),
    ]


def _read(spark: SparkSession, path: str, kind: str, key: str, held: dict[str, str], wanted: Iterable[str]) -> DataFrame | None:
    """The folders of the wanted months or buckets, as far as there are any."""
    by_update: dict[str, list[str]] = {}
    for value in wanted:
        if value in held:
            by_update.setdefault(held[value], []).append(value)
    found = None
    for update, values in sorted(by_update.items()):
        folder = f"{path}/{update}/{kind}"
        part = spark.read.parquet(*[f"{folder}/{key}={value}" for value in values])
        found = part if found is None else found.unionByName(part)
    return found


def update_state(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> State:
    """Merge typed transactions into the state under ``path`` and return the new state.

    Rows that the state has already, and copies among the new ones, change nothing. ``buckets`` counts for
    the first update only. One writer at a time: of two at once, the later list wins.
    """
    before = load_state(spark, path)
    if not before.updates:
        before = State(buckets=buckets)
    update = f"update-{len(before.updates) + 1:08d}-{uuid.uuid4().hex[:8]}"
    try:
        with scratch(spark):
            seen = materialise(seen_places(new))
            latest = as_of(seen).first()["as_of"]
            locations(seen).write.parquet(f"{path}/{update}/{LOCATIONS}")
            # Names rather than numbers: the numbers of two updates differ.
            nested = nested_distinct(new, seen=seen).named()
            visits = materialise(nested.table.withColumn(MONTH, _month(F.col("order_date"))))
            touched = [r[MONTH] for r in visits.select(MONTH).distinct().collect()]
            known = _read(spark, path, VISITS, MONTH, before.months, touched)
            if known is None:
                rows = NestedVisits(visits.drop(MONTH), None).rows(NO_SOURCE)
            else:
                both = materialise(_united(visits.drop(MONTH), known))
                rows = both.withColumn("location", F.explode("fresh")).select(*NO_SOURCE)
                visits = both.drop("fresh").withColumn(MONTH, _month(F.col("order_date")))
            features = _new_features(spark, path, before, rows)
            if touched:
                _write(visits, f"{path}/{update}/{VISITS}", MONTH)
            held = [str(r[BUCKET]) for r in features.select(BUCKET).distinct().collect()]
            if held:
                _write(features, f"{path}/{update}/{FEATURES}", BUCKET)
    except BaseException:
        remove(spark, f"{path}/{update}")
        raise
    dates = [d for d in (before.as_of, latest and latest.isoformat()) if d]
    after = State(
        max(dates, default=None), before.buckets, {**before.months, **dict.fromkeys(touched, update)},
        {**before.features, **dict.fromkeys(held, update)}, [*before.updates, update],
    )
    text = spark.createDataFrame([(json.dumps(after.__dict__),)], "state string")
    text.coalesce(1).write.parquet(f"{path}/{LISTS}/{update}")
    return after


def _write(df: DataFrame, path: str, key: str) -> None:
    """One folder per month or bucket; a large one becomes several files."""
    df.hint("rebalance", key).write.partitionBy(key).parquet(path)


def _united(nested: DataFrame, known: DataFrame) -> DataFrame:
    """The visits of the touched months with the new ones; ``fresh`` are the locations that only these have."""
    keys = list(NO_SOURCE_NO_LOCATION)
    both = nested.withColumnRenamed("places", "new").join(known.withColumnRenamed("places", "old"), keys, "full_outer")
    new, old = (F.array_compact(F.transform(side, lambda place: place["location"])) for side in ("new", "old"))
    return both.select(
        *keys,
        F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old"))
        .otherwise(F.array_union("new", "old")).alias("places"),
        F.when(F.col("old").isNull(), F.array_distinct(new)).otherwise(F.array_except(new, old)).alias("fresh"),
    )


def _new_features(spark: SparkSession, path: str, before: State, rows: DataFrame) -> DataFrame:
    """The features of the touched buckets, as a written table. ``rows`` are the visits that the state had not."""
    added = rows.groupBy(*KEY).agg(*_folds(merge=False)).withColumn(BUCKET, _bucket(before.buckets))
    added = materialise(added)
    touched = [str(r[BUCKET]) for r in added.select(BUCKET).distinct().collect()]
    old = _read(spark, path, FEATURES, BUCKET, before.features, touched)
    if old is None:
        return added
    merged = added.drop(BUCKET).unionByName(old).groupBy(*KEY).agg(*_folds(merge=True))
    return materialise(merged.withColumn(BUCKET, _bucket(before.buckets)))


def state_visits(spark: SparkSession, path: str) -> NestedVisits:
    """All distinct visits of the state."""
    state = load_state(spark, path)
    table = _read(spark, path, VISITS, MONTH, state.months, state.months)
    if table is None:
        raise FileNotFoundError(f"no visits in {path}")
    return NestedVisits(table, None)


def state_features(spark: SparkSession, path: str, today: DateLike | None = None) -> DataFrame:
    """The visit features of all transactions so far, as :func:`features.rfm` makes them from the rows.

    A projection of the stored table: no shuffle, and no visit is read. ``today`` defaults to the latest
    date of all transactions, also of those that cleaning drops.
    """
    state = load_state(spark, path)
    table = _read(spark, path, FEATURES, BUCKET, state.features, state.features)
    if table is None:
        raise FileNotFoundError(f"no features in {path}")
    day = as_date(date.fromisoformat(state.as_of) if today is None else today)
    mean = (F.col("total") / F.col("visits")).alias("value")
    return features_of(table.select(*KEY, F.col("visits").alias("no_visit"), mean, "first_day", "last_day"), day)


def state_locations(spark: SparkSession, path: str) -> DataFrame:
    """All locations of the transactions so far, also of rows that cleaning drops."""
    updates = load_state(spark, path).updates
    if not updates:
        raise FileNotFoundError(f"no locations in {path}")
    return spark.read.parquet(*[f"{path}/{update}/{LOCATIONS}" for update in updates]).distinct()


def clean_state(spark: SparkSession, path: str) -> None:
    """Remove months and buckets that a later update has replaced; no reader of an older state may be left."""
    state = load_state(spark, path)
    for kind, key, held in ((VISITS, MONTH, state.months), (FEATURES, BUCKET, state.features)):
        for update in state.updates:
            folder = f"{path}/{update}/{kind}"
            for name in children(spark, folder):
                if name.startswith(f"{key}=") and held.get(name.split("=", 1)[1]) != update:
                    remove(spark, f"{folder}/{name}")
