"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from custvalue.llm import lexical_search
from custvalue.llm.lexical_search import build_index, ranked_search, search
from tests.llm.conftest import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "item_id long, text string, doc_id string, rank long, block double"


def terms(text):
    return TERM.findall(lower(text))


def brute(rows, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, wanted in asked.items():
        scored = []
        for doc_id, counts, n in docs:
            m = 10 + 90 * n * n_docs // n_words
            score = 0
            for t in wanted & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, count):
    """Frequent and rare words; a third of the rows are one text."""
    rng = random.Random(seed)

    def word():
        return f"W{int(rng.paretovariate(0.7)) % 900}"

    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(count)]
    return rows + [(count + i, "w1 w2 w3 Copy w4") for i in range(count // 2)]


ITEMS = [
    (1, "w1 w2, w3; w4 copy"), (2, "W17 w17 w900 w899 nowhere"), (3, None), (4, ""), (5, "nowhere"), (None, "w5 w6 w300"),
    (6, " ".join(f"w{i}" for i in range(400))), (1, "w77 extra"), (7, "alpha beta1 déjà zé word ten"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in ITEMS], KIND)


@pytest.mark.parametrize("owners,block_bytes,bundle_terms", [(4, 1 << 20, 20_000), (1, 2_000, 50), (3, 500, 7)])
def test_many_blocks_owners_and_bundles(corpus, items, monkeypatch, owners, block_bytes, bundle_terms):
    monkeypatch.setattr(lexical_search, "BUNDLE_TERMS", bundle_terms)
    monkeypatch.setattr(lexical_search, "ROUTE_BYTES", 8 << 20 if owners > 1 else 0)
    rows = made(2, 600)
    found = ranked_search(corpus(rows, 5), items, owners=owners, block_bytes=block_bytes)
    assert got(found) == brute(rows, ITEMS)


def test_odd_rows(corpus, odd_rows, items):
    assert got(ranked_search(corpus(odd_rows), items)) == brute(odd_rows, ITEMS)


def test_fewer_results(corpus, items):
    rows = made(4, 300)
    index = build_index(corpus(rows, 4), block_bytes=3_000)
    for top in (1, 3):
        assert got(search(index, items, top=top)) == brute(rows, ITEMS, top)


def test_empty_tables(corpus, odd_rows, items):
    assert got(ranked_search(corpus([]), items)) == []
    assert got(ranked_search(corpus([(1, None), (2, "- -")]), items)) == []
    assert got(ranked_search(corpus(odd_rows), items.limit(0))) == []


def test_bundles_leave_hopeless_documents_behind(corpus, items):
    """The scores carried to the last owner are fewer than the documents that share a term."""
    rows = [(i, f"w{i % 3} w{3 + i % 7} " + ("rare1 rare2 rare3" if i < 15 else "")) for i in range(3_000)]
    asked = [(1, "w1 w2 w3 w4 rare1 rare2 rare3")]
    spark = items.sparkSession
    index = build_index(corpus(rows, 1))
    wanted = spark.createDataFrame(asked, "item_id long, text string")
    assert got(search(index, wanted)) == brute(rows, asked)
    _, routes = lexical_search._routes(index, lexical_search.item_terms(wanted), 3_000, 4, 1)
    state = lexical_search._departures(index, routes, 1)
    n_words = sum(len(terms(t)) for _, t in rows)
    for owner in range(3):
        here = index.where(f"owner IN (-1, {owner})").selectExpr("*", "0 AS bundle")
        met = state.groupBy("block", "bundle").cogroup(here.groupBy("block", "bundle"))
        state = met.applyInArrow(lexical_search._visit(owner, 3_000, n_words, 10), lexical_search.STATE)
    carried = sum(len(r.slots) // 4 for r in state.collect())
    assert 10 <= carried < 1_500
