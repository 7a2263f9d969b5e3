"""Removed bytes against a set of all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from custvalue.llm import suffix_dedup
from custvalue.llm.queries import op3_suffix_dedup
from custvalue.llm.suffix_dedup import equal_runs, equal_strings, merged, remove_repeats
from tests.llm.conftest import SF

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length=100):
    first, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if data[p : p + length] in first:
                gone[p : p + length] = True
            else:
                first.add(data[p : p + length])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def mixed_rows(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh \n") for _ in range(400)) for _ in range(8)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.5:
                text += rng.choice(parts)[rng.randrange(300) :][: rng.randrange(20, 260)]
            else:
                text += "".join(rng.choice("xyz") for _ in range(rng.randrange(150)))
        rows.append((i, text))
    return rows + [
        (400, "ab" * 3_000), (401, "a" * 5_000), (402, None), (403, ""), (404, "ab" * 70), (405, rows[3][1] * 3),
        (406, "é" * 99 + "x"), (None, rows[5][1]),
    ]


@pytest.mark.parametrize("length", [10, 100])
def test_against_all_strings(corpus, length):
    rows = mixed_rows(3)
    assert found(remove_repeats(corpus(rows, 7), length)) == brute(rows, length)


def test_small_blocks_and_chunks(corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ANCHORS", 50)
    monkeypatch.setattr(suffix_dedup, "FRAGMENT_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "RUN", 64)
    rows = mixed_rows(4)
    assert found(remove_repeats(corpus(rows, 5))) == brute(rows)


@pytest.mark.parametrize("length", [10, 100])
def test_crowded_anchors(corpus, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
    line = "the very same line in a good third of all texts, with others around it"
    rng = random.Random(8)
    rows = mixed_rows(5)
    for i in range(1_000, 1_080):
        words = [rng.choice(["aa", "bb", "cc", line]) for _ in range(12)]
        rows.append((i, " ".join(words)))
    assert found(remove_repeats(corpus(rows, 5), length)) == brute(rows, length)


def test_odd_rows(corpus, odd_rows):
    """Equal rows are one document; other rows that share an id are ordered by a hash."""
    rows = [r for r in odd_rows if r != (5, "other text here")]
    single = sorted(set(rows), key=repr)
    expected = {(i, n, digest): rest for i, n, *rest, digest in brute(single, 20)}
    result = found(remove_repeats(corpus(rows), 20))
    assert len(result) == len(rows)
    ends = {(i, n, digest): rest for i, n, *rest, digest in result}
    assert ends == expected


def test_empty_table(corpus):
    assert remove_repeats(corpus([])).collect() == []


def test_query_over_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op3_suffix_dedup(spark, SF)) == brute(rows)


def test_merged():
    begin, end = merged(np.array([0, 2, 5, 9, 10]), np.array([6, 3, 7, 10, 12]))
    assert (begin.tolist(), end.tolist()) == ([0, 9], [7, 12])


def test_equal_strings():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3_000)).encode(), np.uint8)
    own = np.array([*range(900, 1_400), *range(50, 90), *(rng.randrange(2_980) for _ in range(500))])
    lead = np.array([*range(100, 600), *range(1_050, 1_090), *(rng.randrange(2_980) for _ in range(500))])
    lead[30:60] = own[30:60]
    raw = data.tobytes()
    for length in (1, 2, 7, 20):
        wanted = [raw[a : a + length] == raw[b : b + length] for a, b in zip(own.tolist(), lead.tolist())]
        assert equal_strings(data, own, lead, length).tolist() == wanted
        assert equal_runs(data, own, lead, np.full(len(own), length)).tolist() == wanted
    assert len(equal_strings(data, own[:0], lead[:0], 5)) == len(equal_runs(data, own[:0], lead[:0], own[:0])) == 0


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_strings_that_only_share_a_name(monkeypatch, bits):
    """With few bits most names are those of several strings; the bytes decide."""

    class Few(suffix_dedup.Names):
        def of(self, sums, size):
            return super().of(sums, size) & np.uint64((1 << bits) - 1)

    monkeypatch.setattr(suffix_dedup, "Names", Few)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rows = [(i, t) for i, t in mixed_rows(6) if i is not None and t and len(t) < 500][:16]
    out, length = {}, 20
    columns = {name: [] for name in suffix_dedup.FIELDS}
    for i, text in reversed(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < length:
            continue
        one = (0, data.tobytes(), *(np.array([x]).tobytes() for x in (len(data), i, 0, 0)), *[None] * 4)
        for name, value in zip(suffix_dedup.FIELDS, one):
            columns[name].append(value)
    for row in suffix_dedup._doubled(length)(pa.table(columns)).to_pylist():
        begin, end = np.frombuffer(row["gone"], np.int64).reshape(2, -1)
        out[row["id"]] = (int((end - begin).sum()), len(begin))
    wanted = {i: (removed, spans) for i, _, removed, spans, _ in brute(rows, length) if removed}
    assert wanted and out == wanted
