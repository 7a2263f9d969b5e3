"""The ring against a walk of single keys."""

import zlib
from collections import Counter

import pytest

from custvalue.llm.queries import op5_ring_sharding
from custvalue.llm.sharding import bounded_walk, ring_shards
from tests.llm.conftest import SF


def walk_keys(demand, owners, room):
    """The same walk, one key at a time: in each step, keys by arc and rank."""
    free, place = list(room), {}
    waiting = [(arc, rank) for arc, n in enumerate(demand) for rank in range(n)]
    step = 0
    while waiting:
        rest = []
        for arc, rank in waiting:
            shard = owners[(arc + step) % len(demand)]
            if free[shard]:
                free[shard] -= 1
                place[arc, rank] = shard
            else:
                rest.append((arc, rank))
        waiting, step = rest, step + 1
    return place


@pytest.mark.parametrize("demand", [[3, 0, 7, 1, 1, 0], [12, 0, 0, 0, 0, 0], [0] * 6, [1, 1, 1, 1, 1, 1]])
def test_counts_walk_like_single_keys(demand):
    owners, total = [0, 1, 2, 0, 2, 1], sum(demand)
    room = [total // 3 + (s < total % 3) for s in range(3)]
    slices = bounded_walk(demand, owners, room)
    place = {(a, r): s for a, first, last, s, _ in slices for r in range(first, last)}
    assert place == walk_keys(demand, owners, room)
    slots = Counter((s, slot + r) for _, first, last, s, slot in slices for r in range(last - first))
    assert set(slots.values()) <= {1}


def test_too_little_room():
    with pytest.raises(ValueError, match="less room"):
        bounded_walk([3], [0], [2])


def check(rows, df, shards):
    result = df.collect()
    assert len(result) == len(rows)
    counts = Counter(r.shard for r in result)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in result if r.shard == shard) == list(range(counts[shard]))
    plain = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in result) == plain
    assert {(r.law, r.grown_shard) for r in result} == {("rows", None)}
    return result


def test_odd_rows(corpus, odd_rows):
    check(odd_rows, ring_shards(corpus(odd_rows), shards=4), 4)
    assert ring_shards(corpus([]), shards=4).collect() == []


def test_one_id_for_a_third_of_the_rows(corpus):
    rows = [(7 if i % 3 == 0 else i, f"text {i % 5}") for i in range(300)]
    check(rows, ring_shards(corpus(rows), shards=7), 7)


def test_little_moves_when_a_document_comes(corpus):
    rows = [(i, "x") for i in range(2_000)]
    before = {r.doc_id: r.shard for r in check(rows, ring_shards(corpus(rows), shards=8, virtual=128), 8)}
    after = {r.doc_id: r.shard for r in ring_shards(corpus([*rows, (5_000, "y")]), shards=8, virtual=128).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.05 * len(rows)
    home = {r.doc_id: r.home_shard for r in ring_shards(corpus(rows), shards=8, virtual=128).collect()}
    assert sum(before[i] == home[i] for i in before) > 0.75 * len(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = op5_ring_sharding(spark, SF)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows, df, 40)
    assert "Python" not in df._jdf.queryExecution().toString()
