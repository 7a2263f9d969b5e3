"""Passages, gradients and held-out accuracy of the attention model."""

import numpy as np
import pyarrow as pa
import pytest

from custvalue.llm import quality_model as q
from custvalue.llm import tokens
from custvalue.llm.queries import op8_quality_model

SF = "/root/testdata/sf0.01"


def encode(texts):
    return q.passages(pa.array(texts, pa.string()), tokens.Words(), q._stop_hashes())


def test_passages_cover_whole_texts():
    x, ranges = encode(["a b c", None, "w " * 200, "", "x " * 64])
    assert np.diff(ranges).tolist() == [1, 1, 3, 1, 1]
    assert x.shape == (7, q.FEATURES) and not x[1].any() and not x[5].any()
    assert q.passages(pa.array([], pa.string()), tokens.Words(), q._stop_hashes())[0].shape == (0, q.FEATURES)


def test_a_text_is_encoded_alike_in_any_company(monkeypatch):
    texts = ["one two three two three two three", "THE!! BIG!! ONE!!", "x | y | z " * 90, "der und die " * 30]
    alone = np.concatenate([encode([t])[0] for t in texts])
    together, _ = encode(texts)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    pieces, _ = encode(texts)
    assert np.allclose(alone, together) and np.allclose(alone, pieces)


def test_gradients():
    rng = np.random.default_rng(1)
    w = q._start(3)
    x, ranges = rng.normal(size=(9, q.FEATURES)), np.array([0, 1, 5, 9])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        p = q.forward(w, x, ranges)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    exact = q._gradients(w, x, ranges, labels, q.forward(w, x, ranges))
    for name, values in w.items():
        at = tuple(rng.integers(n) for n in values.shape)
        old, step = values[at], 1e-5
        values[at] = old + step
        up = loss()
        values[at] = old - step
        down = loss()
        values[at] = old
        assert exact[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(2)
    sizes = rng.integers(3, 8, 300)
    ranges = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(ranges[-1], q.FEATURES))
    labels = rng.integers(0, 2, 300).astype(float)
    place = ranges[:-1] + rng.integers(0, sizes)
    x[place, 0] += np.where(labels == 0, 6, 0)  # one odd passage spoils a document
    model = q.train(x, ranges, labels)
    p, a = q.score_bags(model, x, ranges)
    assert ((p > 0.5) == (labels == 1)).mean() > 0.97
    bad = labels == 0
    assert a[place[bad]].mean() > 2 * (1 / sizes[bad]).mean()


@pytest.fixture(scope="module")
def model(spark):
    return q.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_quality_model(spark, SF).collect()
    assert len(rows) == 1_000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_only_texts_and_other_folds_matter(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality", "toxic"
    )
    again = q.fit_quality(docs.selectExpr("doc_id", "text", "'xx' AS lang", "0 AS label").repartition(3), lied)
    assert all(np.allclose(again.weights[k], model.weights[k]) for k in model.weights)


def test_odd_rows(spark, corpus, odd_rows, model):
    rows = q.quality_scores(corpus(odd_rows), None, model).collect()
    assert len(rows) == len(odd_rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert next(r for r in rows if r.doc_id == 4).n_passages == 625
    assert q.quality_scores(corpus([]), None, model).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.quality_scores(corpus(odd_rows), none).collect()} == {0.5}


def test_good_documents_keep_their_columns(corpus, odd_rows, model):
    docs = corpus(odd_rows)
    kept = q.good_documents(docs, None, model)
    scores = q.quality_scores(docs, None, model).collect()
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scores)
