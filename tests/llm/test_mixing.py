"""Mixing against its laws, a plain water level and the expectation of single documents."""

import random

import numpy as np
import pytest

from custvalue.llm.mixing import mix, pivotal, source_targets
from custvalue.llm.queries import op11_pivotal_mixing
from tests.llm.conftest import SF, SPACED

COLUMNS = "doc_id long, text string, source string, size string, target int, share binary"


def targets_of(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Targets by sharing out what is over again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * unit > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**fixed, **{s: weight[s] * unit for s in open_}}
        fixed.update({s: most * sizes[s] for s in over})
        left = share * sum(sizes.values()) - sum(fixed.values())


def check(rows, result, **options):
    """Every law of the contract over the whole result."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(SPACED.findall(text or ""))
    targets = targets_of(sizes, **options)
    most = options.get("most", 3)
    assert sorted((str(r.doc_id), r["size"]) for r in result) == sorted((str(i), len(SPACED.findall(t or ""))) for i, t, _ in rows)
    for source, size in sizes.items():
        own = [r for r in result if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(targets[source])
        assert abs(sum(r.taken for r in own) - targets[source]) <= 0.51
        assert sum(r.cut > 0 for r in own) <= 1
        rate = targets[source] / size if size else 0
        for r in own:
            assert r.taken == r.copies * r["size"] + r.cut <= most * r["size"]
            assert r["size"] == 0 or int(rate + 1e-9) - 1 <= r.copies <= int(rate + 1e-9) + 1


def corpus(spark, rows, partitions=3):
    filled = [(i, t, s, "x", 1, b"y") for i, t, s in rows]
    return spark.createDataFrame(filled, COLUMNS).repartition(partitions)


def made(seed, count):
    """One source holds a third of the rows; sizes are far apart; equal texts and one long text."""
    rng = random.Random(seed)
    sources = ["hot"] * 5 + ["a", "B", "é", "zz", "a b", None, "z", "\U0001f600", "tiny"]
    rows = [(i, "w " * int(rng.paretovariate(1) + rng.randrange(3)), rng.choice(sources)) for i in range(count)]
    return [*rows, (count, "long " * 20_000, "zz"), (count + 1, None, "a"), (count + 2, " \t", "empty")]


@pytest.mark.parametrize("leaf_rows,fan", [(1_024, 256), (16, 2), (10_000, 2), (1, 3)])
def test_laws(spark, leaf_rows, fan):
    rows = made(3, 3_000 if leaf_rows > 1 else 120)
    check(rows, mix(corpus(spark, rows), leaf_rows=leaf_rows, fan=fan).collect())


def test_caps_weights_and_share(spark):
    rows = [(i, "w " * (1 + i % 7), "abcdefgh"[i % 8] if i < 80 else "big") for i in range(4_000)]
    check(rows, mix(corpus(spark, rows)).collect())
    check(rows, mix(corpus(spark, rows), weights=(1, 9), share=0.25, most=1).collect(), weights=(1, 9), share=0.25, most=1)
    with pytest.raises(ValueError, match="whole number"):
        mix(corpus(spark, rows), most=2.5)


def test_reruns_agree(spark):
    rows = made(5, 2_000)
    first, second = (sorted(map(tuple, mix(corpus(spark, r, n)).collect()), key=repr) for r, n in ((rows, 2), (rows[::-1], 7)))
    assert first == second


def test_odd_rows(spark, odd_rows):
    rows = [(i, t, [None, "s", "t", ""][n % 4]) for n, (i, t) in enumerate(odd_rows)]
    check(rows, mix(corpus(spark, rows)).collect())
    assert mix(corpus(spark, rows).where("doc_id < 0")).collect() == []
    blank = mix(corpus(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(200)}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    wanted = targets_of(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == wanted
    assert any(wanted[s] == 3 * sizes[s] for s in sizes) and any(wanted[s] < 3 * sizes[s] for s in sizes)


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 50, 41)
    shares = np.where(rng.random(41) < 0.2, 1.0, rng.random(41))
    total = np.zeros(41)
    for _ in range(4_000):
        prints = rng.integers(-(2**63), 2**63, 41)
        out = pivotal(sizes, shares, prints)
        assert ((out > 0) & (out < 1)).sum() <= 1 and out.min() >= 0 and out.max() <= 1
        assert (out * sizes).sum() == pytest.approx((shares * sizes).sum())
        total += out
    assert np.abs(total / 4_000 - shares)[sizes > 0].max() < 0.04
    equal = pivotal(np.full(8, 10), np.full(8, 0.5), rng.integers(0, 2**40, 8))
    assert sorted(equal) == [0.0] * 4 + [1.0] * 4


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    df = op11_pivotal_mixing(spark, SF)
    assert df.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    check(rows, df.collect())
