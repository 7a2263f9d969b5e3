"""Components of similar documents against all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from custvalue.llm import jaccard_join
from custvalue.llm.graph import components
from custvalue.llm.jaccard_join import jaccard_components, one_of_each
from custvalue.llm.queries import op2_jaccard_join
from tests.llm.conftest import SF, shingles_of


def brute(rows):
    """Component by doc_id over all pairs; rows that share an id are one document."""
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, shingles_of(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((find(i), find(j)))
            top[high] = low
    return sorted(
        ((i, len(shingles_of(t)), None if i is None else find(i)) for i, t in rows), key=repr
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(count, seed, share=0.06):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(500)]
    rows = []
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    for i in range(count):
        words = list(rng.choice(bases))
        for k in range(len(words)):
            if rng.random() < share:
                words[k] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("share", [0.0, 0.02, 0.05])
def test_near_copies(corpus, share):
    rows = near_copies(160, 3, share)
    assert found(jaccard_components(corpus(rows))) == brute(rows)


def test_many_small_blocks(corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 500)
    rows = near_copies(120, 4)
    assert found(jaccard_components(corpus(rows))) == brute(rows)


def test_second_round_finds_what_neighbours_miss(corpus):
    rows = near_copies(120, 5, 0.04)
    assert found(jaccard_components(corpus(rows), nearest=1)) == brute(rows)


def test_counts_in_short_lists_drop_candidates_and_no_link(corpus, spark):
    rows = near_copies(160, 7, 0.03)
    sets = jaccard_join.shingle_sets(corpus(rows)).where("ranked IS NOT NULL")
    members = jaccard_join._members(sets, spark.createDataFrame([], "doc_id long, first long")).cache()
    lists = members.mapInArrow(jaccard_join._short_lists, jaccard_join.LISTS).withColumn("root", F.col("id"))
    merged = jaccard_join._merged(lists, 0.75).collect()
    assert all(r.aside < r.n for r in members.collect())
    assert any(r.at_least > 1 for r in merged)
    kept = [r for r in merged if r.hits >= r.at_least]
    assert len(kept) < len(merged)
    names = {r.member: r.id for r in members.collect()}
    texts = {i: shingles_of(t) for i, t in rows}
    linked = {
        (i, j) for i, j in combinations(sorted(names.values()), 2)
        if 100 * len(texts[i] & texts[j]) >= 75 * len(texts[i] | texts[j])
    }
    assert linked <= {tuple(sorted((names[r.member_a], names[r.member_b]))) for r in kept}
    found = jaccard_join._occurring(lists, members, 0.75).collect()
    assert sorted(tuple(sorted(r)) for r in found) == sorted(linked)


def test_a_third_round_leaves_few_open_pairs_of_a_large_group(corpus, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(len(words)), rng.randrange(1, 5)):
            words[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    joined = []
    merged = jaccard_join._merged

    def counted(lists, threshold):
        out = merged(lists, threshold)
        joined.append(out.agg(F.sum("hits")).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard_join, "_merged", counted)
    assert found(jaccard_components(corpus(rows), nearest=1)) == brute(rows)
    assert joined[0] < 70_000  # 44,681; after two rounds 101,370


def test_partners_beyond_the_neighbours(corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    rows = near_copies(140, 8, 0.05)
    rows += rows[::9] + [(i, t + " and more") for i, t in rows[::7]]  # repeated rows and ids
    assert found(jaccard_components(corpus(rows), nearest=0)) == brute(rows)


def test_odd_rows(corpus, odd_rows):
    assert found(jaccard_components(corpus(odd_rows))) == brute(odd_rows)


def test_empty_table(corpus):
    df = jaccard_components(corpus([]))
    assert df.collect() == [] and df.columns == ["doc_id", "n_shingles", "component_id"]


def test_query_over_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op2_jaccard_join(spark, SF)) == brute(rows)


def test_one_document_of_each_group_stays(corpus, odd_rows):
    rows = near_copies(100, 6) + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    docs = corpus(rows)
    expected = sorted((str(i) for i, _, c in brute(rows) if i == c), key=repr)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect()), key=repr) == expected


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 900L, 901L"))
    rows = {r.id: r.root for r in components(edges).collect()}
    assert rows == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
