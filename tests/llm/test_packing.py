"""Every token is placed once, in bins of permitted size."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from custvalue.llm.packing import CAPACITIES, best_fit, bin_cost, pack
from custvalue.llm.queries import op1_best_fit_packing
from tests.llm.conftest import SF, SPACED


def check(lengths, capacities=CAPACITIES):
    bins, offsets, final = best_fit(lengths, capacities)
    parts = defaultdict(list)
    for length, b, offset in zip(lengths, bins, offsets):
        parts[b].append((offset, length))
    assert len(parts) == len(final)
    for b, own in parts.items():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert final[b] == min(c for c in capacities if c >= end)
    return final


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_their_pieces(seed):
    rng = random.Random(seed)
    check([rng.randrange(1, 8_193) if rng.random() < 0.2 else rng.randrange(1, 600) for _ in range(800)])


def test_edges():
    assert best_fit([], CAPACITIES) == ([], [], [])
    assert check([8_192]) == [8_192] and check([1]) == [512] and check([513]) == [1_024]
    assert check([512] * 5) == [512] * 5
    assert sorted(check([300, 212, 300, 212])) == [512, 512]  # exact fits


def test_small_bins_are_cheaper_when_they_fill():
    """Joint lengths cost less than any single permitted length."""
    rng = random.Random(1)
    lengths = [rng.randrange(1, 500) for _ in range(2_000)]
    joint = sum(map(bin_cost, check(lengths)))
    assert all(joint <= sum(map(bin_cost, check(lengths, (c,)))) for c in CAPACITIES)
    assert sum(lengths) / sum(check(lengths)) > 0.97


def verify(df, totals, capacities=CAPACITIES):
    bins, placed = defaultdict(list), defaultdict(int)
    for r in df.collect():
        bins[r.bin_id, r.bin_capacity].append((r.bin_offset, r.length))
        placed[r.doc_id] += r.length
        assert r.start == r.piece * max(capacities)
    assert placed == totals
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), own in bins.items():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert capacity == min(c for c in capacities if c >= end)


def totals(rows):
    out = defaultdict(int)
    for i, text in rows:
        out[i] += len(SPACED.findall(text or "")) + 1
    return out


def test_odd_rows(corpus, odd_rows):
    verify(pack(corpus(odd_rows)), totals(odd_rows))
    verify(pack(corpus(odd_rows), (16, 64)), totals(odd_rows), (16, 64))
    verify(pack(corpus(odd_rows), group_pieces=2), totals(odd_rows))
    assert pack(corpus([])).collect() == []


def test_given_lengths(corpus):
    df = pack(corpus([(1, "x"), (2, None)]), length=F.col("n") * 1_500)
    verify(df, {1: 10_500, 2: 10_500})


def test_one_id_for_all_rows(corpus):
    rows = [(1, "a b c")] * 500
    df = pack(corpus(rows), group_pieces=50)
    verify(df, totals(rows))
    assert len({r.bin_id >> 32 for r in df.collect()}) > 3


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    verify(op1_best_fit_packing(spark, SF), totals(rows))
