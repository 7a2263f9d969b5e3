import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.operators import ranks
from custvalue.operators.ranks import median, order_statistics
from custvalue.operators.spenders import customer_totals, spender_count, spender_flags, spenders
from custvalue.rules import Rules
from tests.conftest import rows_of


@pytest.fixture(params=[(16, 1 << 16), (16, 0)], ids=["two rounds", "all bits"])
def rounds(request, monkeypatch):
    """Run a test as small data goes, and through every round."""
    digit, buckets = request.param
    monkeypatch.setattr(ranks, "DIGIT_BITS", digit)
    monkeypatch.setattr(ranks, "BUCKETS", buckets)


def skewed(seed, size):
    """One group holds most rows, and one value a third of them."""
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.7 else rng.choice("abcdefgh"),
         7.25 if rng.random() < 0.33 else round(rng.lognormvariate(0, 3), 2))
        for _ in range(size)
    ]
    return rows + [("one", 5.0), ("two", 1.0), ("two", 2.0)]


def test_median_equals_brute_force(spark, rounds):
    rows = skewed(1, 40_000)
    df = materialise(spark.createDataFrame(rows, "g string, v double"))
    got = median(df, "v", "m", ["g"], extra=[F.count(F.lit(1)).alias("n")])
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    expected = {g: (statistics.median(vs), len(vs)) for g, vs in groups.items()}
    assert {r.g: (r.m, r.n) for r in got.collect()} == expected


def test_every_rank_of_a_skewed_column(spark, rounds):
    rows = skewed(3, 30_000)
    values = sorted(v for _, v in rows)
    df = materialise(spark.createDataFrame([(1, v) for v in values], "k int, v double"))
    for rank in (1, 15_001, len(values) + 5):
        row = order_statistics(df, "v", {"x": lambda _, r=rank: F.lit(r)}, ["k"]).first()
        expected = values[min(rank, len(values)) - 1]
        assert row["x"] == expected
        assert row["x_below"] == sum(v < expected for v in values)
        assert row["x_equal"] == values.count(expected)


def test_without_the_broadcast(spark, rounds, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", 0)
    rows = skewed(5, 5_000)
    df = materialise(spark.createDataFrame(rows, "g string, v double"))
    got = median(df, "v", "m", ["g"])
    assert got.join(df.groupBy("g").agg(F.median("v").alias("e")), "g").filter("m != e").count() == 0


def test_ranks_outside(spark, rounds):
    df = spark.createDataFrame([(1, 4.0), (1, 5.0)], "k int, v double")
    assert order_statistics(df, "v", {"x": lambda _: F.lit(0)}, ["k"]).first()["x"] is None
    assert order_statistics(df.filter("v > 9"), "v", {"x": lambda _: F.lit(1)}, ["k"]).count() == 0


EXTREMES = [
    0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
    -1.7976931348623157e308, math.inf, -math.inf, math.nan, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 8.0,
    math.nextafter(8.0, 0), 2.0**-1030, 3.0, 1e15 + 0.5, 0.1, 0.2, 0.30000000000000004, 0.3, -0.3,
]


def test_keys_order_like_values(spark):
    """Keys are the bits of a double, so equal keys are equal values."""
    rng = random.Random(4)
    bits = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4_000)]
    powers = [2.0**e for e in range(-1_074, 1_024)]
    values = EXTREMES + bits + powers + [math.nextafter(p, 0) for p in powers] + [-math.nextafter(p, math.inf) for p in powers]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, key in ranks.with_ordered_key(df, "v", "key").collect():
        if math.isnan(v):
            assert key == 2**63 - 1
        else:
            plain = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
            assert key == (-plain if v < 0 else plain)


def test_kinds_of_values(spark):
    for kind, values in (("int", [3, -2**31, 2**31 - 1, 0, 0]), ("long", [2**62, -(2**63), 2**63 - 1, 7, 7]), ("float", [0.5, -1.5, 9.0])):
        df = spark.createDataFrame([(1, v) for v in values], f"k int, v {kind}")
        for rank, expected in enumerate(sorted(values), 1):
            assert order_statistics(df, "v", {"x": lambda _, r=rank: F.lit(r)}, ["k"]).first()["x"] == expected
    with pytest.raises(TypeError, match="string"):
        order_statistics(spark.createDataFrame([(1, "a")], "k int, v string"), "v", {}, ["k"])


def test_far_ranks_in_one_call(spark, rounds):
    rows = skewed(6, 6_000)
    df = materialise(spark.createDataFrame(rows, "g string, v double"))
    wanted = {"low": lambda n: F.ceil(n * 0.1), "none": lambda n: F.lit(0), "high": lambda n: n, "past": lambda n: n + 7}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for row in order_statistics(df, "v", wanted, ["g"]).collect():
        values = sorted(groups[row.g])
        low = math.ceil(len(values) * 0.1)
        assert (row.low, row.low_rank, row.high, row.past) == (values[low - 1], low, values[-1], values[-1])
        assert row.none is None and row.none_below is None


def test_only_counts_of_buckets_meet(spark):
    """No sketch, no list of rows: every exchange but that of the extra aggregates carries folded counts."""
    df = materialise(spark.createDataFrame(skewed(7, 500), "g string, v double"))
    plan = order_statistics(df, "v", {"x": lambda n: n}, ["g"])._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan and "Python" not in plan


def take(totals, share, side):
    """First n customers by total and id, where every customer has one scored row."""
    n = round(len(totals) * share)
    order = sorted(totals, key=lambda r: (-r[1] if side == "top" else r[1], r[0]))
    return sorted(order[:n])


@pytest.mark.parametrize("share", [0.25, 0.999, 0.0])
def test_spenders_with_many_ties(spark, make_clv, share):
    rng = random.Random(9)
    totals = [(i, 10.0 if rng.random() < 0.4 else float(rng.randint(1, 400))) for i in range(3_001)]
    rng.shuffle(totals)
    clv = make_clv(*[{"ctc_id": c, "location": "A", "value": v} for c, v in totals])
    rules = Rules(spender_share=share)
    for side in ("top", "low"):
        got = [tuple(r) for r in spenders(clv, side, rules).orderBy("ctc_id").collect()]
        assert got == take(totals, share, side)


def test_cut_inside_one_shared_total(make_clv):
    clv = make_clv(*[{"ctc_id": c, "location": "A", "value": 5.0} for c in range(10)])
    assert rows_of(spenders(clv, "top"), "ctc_id") == [(0,), (1,)]
    assert rows_of(spenders(clv, "low"), "ctc_id") == [(0,), (1,)]


def test_count_rounds_half_even_over_rows_not_customers(make_clv):
    ten = make_clv(*[{"ctc_id": c, "location": p} for c in range(5) for p in "AB"])
    assert spender_count(customer_totals(ten), 0.25).first()[0] == 2
    fourteen = make_clv(*[{"ctc_id": c, "location": p} for c in range(2) for p in "ABCDEFG"])
    assert spender_count(customer_totals(fourteen), 0.25).first()[0] == 4
    # Four places for two customers: both are top and low.
    flags = rows_of(spender_flags(fourteen), "ctc_id", "is_top", "is_low")
    assert flags == [(0, True, True), (1, True, True)]


def test_no_customers_no_spenders(make_clv):
    assert spenders(make_clv({"ctc_id": 1, "location": "A"}).filter("ctc_id > 1"), "top").count() == 0
