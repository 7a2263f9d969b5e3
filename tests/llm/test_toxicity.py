"""The grammar on single clauses, and held-out accuracy of what is learned."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custvalue.llm import tokens
from custvalue.llm.labelled import training_sample
from custvalue.llm.queries import op7_toxicity
from custvalue.llm.toxicity import (
    BIAS,
    END,
    GRAMMAR,
    OUTCOMES,
    PRIORS,
    Lexicon,
    ToxicModel,
    clause_features,
    fit_toxicity,
    insult,
    negation,
    report,
    target,
    threat,
    toxicity,
)


def outcomes(text):
    found = clause_features(pa.array([text]), Lexicon({}), tokens.Words(tokens.ALNUM))[0]
    return {name: x for name, x in zip(OUTCOMES, found) if x}


@pytest.mark.parametrize("text, expected", [
    ("what an idiot", {"insult": 1}),
    ("You are an IDIOT and a moron", {"targeted insult": 2}),
    ("you are not an idiot", {"denied insult": 1}),
    ("not that this is an idiot", {"insult": 1}),  # beyond the negation's reach
    ("she said he was a loser", {"reported insult": 1}),
    ("she said so. You loser", {"targeted insult": 1}),  # another clause
    ("they will kill them", {"targeted threat": 1}),
    ("the idiots, you said", {"insult": 1}),
    ("I will kill you", {"targeted threat": 1}),
    ("we will hurt and burn them", {"targeted threat": 2}),
    ("kill the process", {"threat": 1}),
    ("kill the process. You said so", {"threat": 1}),  # another clause
    ("I will not kill you", {"denied threat": 1}),
    ("kill the process before you go", {"threat": 1}),  # the object is no person
    ("you should stab the fork into the cake", {"threat": 1}),
    ("burn the CD and send it to her", {"threat": 1}),
    ("kill and send it to her", {"threat": 1}),
    ("we will kill all of you", {"targeted threat": 1}),
    ("I would kill them", {"targeted threat": 0.5}),
    ("if they kill the lights", {"threat": 0.5}),
    ("hurt, stab, burn or kill them", {"threat": 1, "targeted threat": 3}),  # so many wait for an object
    ("kill idiots", {"targeted threat": 1, "insult": 1}),
    ("they will kill", {"threat": 1}),
    ("she said he will kill them", {"reported threat": 1}),
    ("you are such an idiot", {"targeted insult": 1}),
    ("you total idiot", {"targeted insult": 1.5}),
    ("idiotic and trashy", {}),
    ("", {}), (None, {}),
])
def test_clauses(text, expected):
    assert outcomes(text) == expected


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts whose toxic ones have an unknown insult with changing ends."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), "qwzrx" + rng.choice(words))
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: t for i, _, t in rows}


def test_learns_word_beginnings(labelled):
    docs, labels, truth = labelled
    held = [r for r in toxicity(docs, labels).collect() if r.held_out]
    assert 120 < len(held) < 240
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert np.mean(right) > 0.97


def test_held_out_labels_and_other_columns_do_not_matter(spark, labelled):
    docs, labels, _ = labelled
    model = fit_toxicity(docs, labels)
    lied = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    again = fit_toxicity(docs.selectExpr("doc_id", "text", "'x' AS label", "1 AS toxic"), lied)
    assert again.learned == model.learned and np.allclose(again.weights, model.weights)


def test_odd_rows(spark, corpus, odd_rows, labelled):
    model = fit_toxicity(*labelled[:2])
    result = toxicity(corpus([*odd_rows, (50, "you idiot")]), None, model).collect()
    assert len(result) == len(odd_rows) + 1
    plain = {r.score for r in result if r.doc_id != 50}
    assert len(plain) == 1 and 0 < plain.pop() < 0.5
    assert next(r for r in result if r.doc_id == 50).predicted == 1
    assert toxicity(corpus([]), None, model).collect() == []
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity(corpus(odd_rows), empty).collect()} == {0}


def test_query_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [r for r in op7_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_a_threat_to_a_person_scores_above_one_to_a_thing(corpus):
    """With the prior weights, where all four once had one score."""
    texts = ["I will kill you", "kill the process before you go", "you should stab the fork into the cake",
             "burn the CD and send it to her"]
    model = ToxicModel({}, np.array(list(PRIORS.values())), BIAS)
    rows = toxicity(corpus(list(enumerate(texts))), None, model).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[0] > max(scores[1], scores[2], scores[3]) + 0.15


def test_composition_is_reading_one_after_the_other():
    """The composed machine gives what the five give in a row, on random clauses."""
    rng = random.Random(2)
    machines = [negation(), report(), insult(), threat(), target()]
    for _ in range(2_000):
        clause = [rng.choice(range(11)) for _ in range(rng.randrange(12))] + [END]
        given = [(symbol, 1.0) for symbol in clause]
        for machine in machines:
            state, out = machine.start, []
            for symbol, weight in given:
                state, results = machine.step[state][symbol]
                out += [(result, weight * more) for result, more in results]
            given = out
        state, found = GRAMMAR.start, []
        for symbol in clause:
            state, results = GRAMMAR.step[state][symbol]
            found += [(OUTCOMES[outcome], weight) for outcome, weight in results]
        assert found == given and state == GRAMMAR.start


def test_a_tiny_share_of_very_many_labels_is_no_empty_sample(spark):
    """The threshold uses all bits of the hash: a hundredth of 200,000 labels, down to single rows."""
    docs = spark.range(200_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS toxic")
    for rows in (2_000, 20):
        got = training_sample(docs, labels, "toxic", F.lit(False), rows).count()
        assert 0.5 * rows < got < 1.6 * rows
