"""Importance resampling against a plain loop over features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from custvalue.llm.importance import resample
from tests.llm.conftest import lower

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    words = ALNUM.findall(lower(text))
    runs = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    return words, runs


def brute(rows, target, max_n=1, buckets=10_000, share=10, min_words=20, seed=2024):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, text in rows for f in features(text, max_n)[1])
    t = Counter(bucket(f) for text in target for f in features(text, max_n)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in rows:
        words, runs = features(text, max_n)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, runs)
        )
        key = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(runs), weight, score, None, len(words)])
    able = [r for r in out if r[5] >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * share // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


TARGET = ["Alpha beta1 gamma ten nine", None, "", "die die zé\x00z déjà"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(t, 1, 2.0) for t in TARGET], "text string, bucket int, score double")


@pytest.mark.parametrize("max_n,share,min_words", [(1, 10, 20), (1, 50, 0), (2, 30, 1), (3, 100, 2)])
def test_odd_rows(corpus, odd_rows, target, max_n, share, min_words):
    options = dict(max_n=max_n, share=share, min_words=min_words, buckets=500)
    assert got(resample(corpus(odd_rows), target, **options)) == brute(odd_rows, TARGET, **options)


def test_empty_tables(corpus, odd_rows, target):
    assert got(resample(corpus([]), target)) == []
    assert got(resample(corpus(odd_rows), target.limit(0))) == brute(odd_rows, [])


def test_equal_scores_and_rows(corpus, target):
    """A third of the rows are one row; a draw cuts through them."""
    rows = [(7, "alpha beta1 nine")] * 40 + [(None, "alpha " * 30)] * 10 + [(i, f"word{i % 3} ten") for i in range(70)]
    for share in (10, 35, 60, 99):
        options = dict(share=share, min_words=2)
        assert got(resample(corpus(rows, 5), target, **options)) == brute(rows, TARGET, **options)
