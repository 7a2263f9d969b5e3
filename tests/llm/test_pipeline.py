"""The pipeline's stages against brute force, and how it is registered."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from custvalue.functions.materialise import materialise
from tests.llm.conftest import SF, shingles_of, words_of


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    columns = stages["documents"].dtypes
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == columns


def test_quality_keeps_what_the_model_accepts(spark, stages):
    from custvalue.llm.queries import op8_quality_model

    good = {r.doc_id for r in op8_quality_model(spark, SF).collect() if r.predicted}
    assert set(texts(stages["quality"])) == good


def test_one_of_each_group_of_near_duplicates_stays(stages):
    before, after = texts(stages["quality"]), texts(stages["near_duplicates"])
    sets = {i: shingles_of(t) for i, t in before.items()}
    top = {i: i for i in before}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                top[high] = low
    assert after == {i: before[i] for i in before if find(i) == i}


def test_repeated_passages_go_and_the_rest_stays(stages):
    before, after = texts(stages["near_duplicates"]), texts(stages["passages"])
    first = {}
    for i in sorted(before):
        words = words_of(before[i])
        repeated = set()
        for k in range(len(words) - 50):
            if first.setdefault(tuple(words[k : k + 51]), i) != i:
                repeated.update(range(k, k + 51))
        kept = words_of(after.get(i, ""))
        assert len(kept) <= len(words) - len(repeated)
        if before[i] == after.get(i):
            assert not repeated
    lengths = {r.doc_id: r.n_chars for r in stages["passages"].collect()}
    assert lengths == {i: len(t) for i, t in after.items()}


def test_benchmark_items_are_gone(spark, stages):
    before, after = texts(stages["passages"]), texts(stages["benchmark_items"])
    items = [shingles_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, t in before.items() for s in items if 100 * len(shingles_of(t) & s) >= 75 * len(s)}
    assert after == {i: t for i, t in before.items() if i not in dirty}


def test_sequences_hold_every_token(stages):
    placed = {}
    for r in stages["sequences"].collect():
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == {i: len(words_of(t)) + 1 for i, t in texts(stages["benchmark_items"]).items()}


def test_run_is_all_stages(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.piece, r.length) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["sequences"])


def test_registered():
    assert queries()["pipeline"] is corpus_pipeline.run
    assert {n for n in range(1, 14)} == {int(k[2:].split("_")[0]) for k in queries() if k.startswith("op")}
    assert "op9_quality_rules" in oracle_sql()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
