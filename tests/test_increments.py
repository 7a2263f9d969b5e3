"""States that grow by updates against everything at once."""

import random

import pytest
from pyspark.sql import functions as F

from custvalue.functions.files import children
from custvalue.operators.cleaning import ALL_COLUMNS, NO_SOURCE, NO_SOURCE_NO_LOCATION, as_of, distinct_rows
from custvalue.operators.features import rfm
from custvalue.operators.overview import locations
from custvalue.plans import increments
from custvalue.plans.increments import clean_state, load_state, state_features, state_locations, state_visits, update_state
from tests.conftest import rows_of


def made(seed, count, months):
    """A third of the rows are copies of one; nulls anywhere; values add up exactly."""
    rng = random.Random(seed)
    rows = [
        (rng.choice([*range(30), None]), f"2021-{rng.choice(months):02}-{1 + rng.randrange(28):02}",
         rng.choice(["w", "v", None]), rng.choice(["A", "A", "B", None]), rng.choice([1, 2, -3.5, None]))
        for _ in range(count)
    ]
    return rows + [(7, "2021-03-05", "w", "A", 4)] * (count // 2)


def test_updates_equal_everything_at_once(spark, make_tx, tmp_path):
    path = str(tmp_path)
    parts = [made(1, 200, [1, 2, 3]), made(2, 100, [3, 4]), [], made(1, 200, [1, 2, 3]), [(None, "2022-09-09", "w", "late", 1)]]
    for part in parts:
        update_state(spark, path, make_tx(*part) if part else make_tx(*parts[0]).filter("ctc_id < -1"), buckets=8)
    whole = make_tx(*[row for part in parts for row in part])
    assert rows_of(state_features(spark, path)) == rows_of(rfm(whole))
    assert rows_of(state_features(spark, path, "2023-01-01")) == rows_of(rfm(whole, "2023-01-01"))
    for columns in (ALL_COLUMNS, NO_SOURCE, NO_SOURCE_NO_LOCATION):
        assert rows_of(state_visits(spark, path).rows(columns)) == rows_of(distinct_rows(whole, columns))
    assert rows_of(state_locations(spark, path)) == rows_of(locations(whole))
    assert load_state(spark, path).as_of == as_of(whole).first()[0].isoformat() == "2022-09-09"
    before = rows_of(state_features(spark, path)), rows_of(state_visits(spark, path).table.drop("places"))
    clean_state(spark, path)
    assert (rows_of(state_features(spark, path)), rows_of(state_visits(spark, path).table.drop("places"))) == before
    first = load_state(spark, path).updates[0]
    held = load_state(spark, path).months
    assert {n for n in children(spark, f"{path}/{first}/visits") if "=" in n} == {f"month={m}" for m in held if held[m] == first}


def test_what_is_not_touched_is_not_read(spark, make_tx, tmp_path):
    path = str(tmp_path)
    update_state(spark, path, make_tx(*made(3, 300, [1, 2, 3])), buckets=8)
    state = load_state(spark, path)
    bucket = str(spark.createDataFrame([(5,)], "ctc_id long").select(increments._bucket(8)).first()[0])
    new = make_tx((5, "2021-02-03", "w", "A", 1234), (5, "2021-06-03", "w", "C", 1))
    # Everything but the bucket and the month of the new rows is unreadable while they are merged.
    spoiled = [tmp_path / state.updates[0] / "features" / f"bucket={b}" for b in state.features if b != bucket]
    spoiled += [tmp_path / state.updates[0] / "visits" / f"month={m}" for m in state.months if m != "2021-02"]
    kept = {file: file.read_bytes() for folder in spoiled for file in folder.iterdir()}
    for file in kept:
        file.write_bytes(b"no table")
    after = update_state(spark, path, new)
    for file, content in kept.items():
        file.write_bytes(content)
    update = after.updates[-1]
    assert [b for b, held in after.features.items() if held == update] == [bucket]
    assert sorted(m for m, held in after.months.items() if held == update) == ["2021-02", "2021-06"]
    whole = make_tx(*made(3, 300, [1, 2, 3])).unionByName(new)
    assert rows_of(state_features(spark, path)) == rows_of(rfm(whole))


def test_the_features_of_a_state_need_no_shuffle(spark, make_tx, tmp_path):
    update_state(spark, str(tmp_path), make_tx(*made(4, 50, [1])))
    plan = state_features(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "order_date" not in plan


def test_a_failed_update_changes_nothing(spark, make_tx, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        state_features(spark, path)
    update_state(spark, path, make_tx(*made(5, 50, [1])))
    before = load_state(spark, path), sorted(children(spark, path))
    broken = make_tx((1, "2021-01-01", "w", "A", 1)).withColumn("value", F.expr("raise_error('x')").cast("double"))
    with pytest.raises(Exception, match="x"):
        update_state(spark, path, broken)
    assert (load_state(spark, path), sorted(children(spark, path))) == before
