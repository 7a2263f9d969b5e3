"""Small corpora that every text operator must cope with."""

from __future__ import annotations

import random
import re

import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return SPACED.findall(lower(text))


def shingles_of(text, size=5):
    words = words_of(text)
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


SCHEMA = "doc_id long, text string, n long, id long, label int, row string, print double, score string, alive binary"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows of (doc_id, text) with columns whose names the operators use themselves."""

    def make(rows, partitions=3):
        filled = [(i, t, 7, -1, 1, "x", 0.5, "y", b"z") for i, t in rows]
        return spark.createDataFrame(filled, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated texts, equal rows, ids that repeat or are missing."""
    rng = random.Random(9)
    long_ = " ".join(rng.choice(["alpha", "Beta", "gamma,", "déjà", "x"]) + str(rng.randrange(400)) for _ in range(40_000))
    same = "one two three four five six seven eight nine ten"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, long_), (5, same), (5, same), (6, same), (7, "word"), (8, "word"),
        (9, "ÄÖ ü\x1fé\x00z"), (10, "die " * 500), (None, same), (None, None), (11, "a" * 3_000), (5, "other text here"),
    ]
