"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every passage is encoded as a
vector of shape and repetition measures; a hidden layer turns it into a representation ``h``. Gated
attention gives each passage a weight, a softmax over ``w . (tanh(V h) * sigmoid(U h))`` within its
document, and the document's score is a logistic function of the weighted mean of its ``h``. All
parts are learned together from the document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm import tokens
from custvalue.llm.labelled import held_out, training_sample
from custvalue.llm.quality_rules import STOP_WORDS

SAMPLE = 6_000  # labelled documents to learn from
SAMPLE_PASSAGES = 2_000  # a longer document is not learned from (but scored whole)
PASSAGE_WORDS = 64
FOLDS, FOLD = 3, 1
HIDDEN, GATE = 12, 8
EPOCHS, RATE, DECAY = 400, 0.02, 1e-4


def _class(characters: str) -> np.ndarray:
    return np.array([chr(b) in characters if b < 128 else False for b in range(256)])


# Shares of a passage's bytes in these classes.
BYTE_CLASSES = (
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("#*$%&<>"), _class("|"), _class("!?"), _class("0123456789"),
    _class(".,;:"), _class("\n"), _class("@/\\_={}[]~^+"),
)
FEATURES = len(BYTE_CLASSES) + 8


def _stop_hashes() -> np.ndarray:
    words = tokens.Words(tokens.ALNUM)
    low, starts, ends, _ = words.find(*tokens.texts(pa.array(list(STOP_WORDS))))
    return np.sort(words.hash(low, starts, ends))


def passages(column: pa.Array, words: tokens.Words, stops: np.ndarray):
    """Vectors of the passages of many texts, and the range of each text in them.

    A passage is a run of ``PASSAGE_WORDS`` words, the last of a text up to one and a half times as
    long. A text without words is one passage of zeros.
    """
    data, bounds = tokens.texts(column)
    out, sizes = [], []
    for first, last in tokens.pieces(bounds):
        begin, end = bounds[first], bounds[last]
        raw = data[begin:end]
        low, starts, ends, ranges = words.find(raw, bounds[first : last + 1] - begin)
        counts = np.diff(ranges)
        number = np.maximum(1, (counts + PASSAGE_WORDS // 2) // PASSAGE_WORDS)
        sizes.append(number)
        total = int(number.sum())
        x = np.zeros((total, FEATURES))
        out.append(x)
        if len(starts) == 0:
            continue
        base = np.cumsum(number) - number
        doc = np.repeat(np.arange(last - first), counts)
        inside = np.arange(len(starts)) - ranges[doc]
        passage = base[doc] + np.minimum(inside // PASSAGE_WORDS, number[doc] - 1)
        at = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        mine = passage[at]
        size = np.diff(np.append(at, len(starts)))
        a, b = starts[at], ends[np.append(at[1:], len(starts)) - 1]
        for c, members in enumerate(BYTE_CLASSES):
            sums = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(members[raw], out=sums[1:])
            x[mine, c] = (sums[b] - sums[a]) / (b - a)
        hashes = words.hash(low, starts, ends)
        length = (ends - starts).astype(float)
        mean = np.add.reduceat(length, at) / size
        c = len(BYTE_CLASSES)
        x[mine, c] = np.minimum(mean, 40) / 10
        spread = np.add.reduceat(length * length, at) / size - mean * mean
        x[mine, c + 1] = np.minimum(np.sqrt(np.maximum(spread, 0)), 40) / 10
        order = np.lexsort((hashes, passage))
        again = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        repeated = np.zeros(len(starts))
        repeated[order[1:]] = again
        x[mine, c + 2] = np.add.reduceat(repeated, at) / size
        same = np.zeros(len(starts))
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        x[mine, c + 3] = np.add.reduceat(same, at) / size
        # Words in 3-word runs that the document has more than once.
        grams, spans = tokens.shingles(hashes, ranges, 3)
        owner = np.repeat(np.arange(last - first), np.diff(spans))
        order = np.lexsort((grams, owner))
        pair = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        known = np.zeros(len(grams), bool)
        known[order[1:]] |= pair
        known[order[:-1]] |= pair
        place = ranges[owner] + np.arange(len(grams)) - spans[owner]
        twice = np.zeros(len(starts))
        twice[place[known]] = 1
        x[mine, c + 4] = np.add.reduceat(twice, at) / size
        hit = stops[np.minimum(np.searchsorted(stops, hashes), len(stops) - 1)] == hashes
        x[mine, c + 5] = np.add.reduceat(hit.astype(float), at) / size
        x[mine, c + 6] = np.log1p(size) / 5
        x[mine, c + 7] = np.log1p(counts[doc[at]]) / 10
    ranges = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(out) if out else np.zeros((0, FEATURES))), ranges


class AttentionModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "hidden": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "hidden_bias": np.zeros(HIDDEN),
        "tanh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "attention": rng.normal(0, GATE**-0.5, GATE), "score": rng.normal(0, HIDDEN**-0.5, HIDDEN), "bias": np.zeros(1),
    }


def forward(w: dict[str, np.ndarray], x: np.ndarray, ranges: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of the bags ``x[ranges[i]:ranges[i + 1]]``, none of them empty, with what led to them."""
    at, sizes = ranges[:-1], np.diff(ranges)
    h = np.tanh(x @ w["hidden"] + w["hidden_bias"])
    t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    e = (t * g) @ w["attention"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
    a = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["bias"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def _gradients(w, x, ranges, labels, f):
    at, sizes = ranges[:-1], np.diff(ranges)
    d = (f["p"] - labels) / len(labels)
    out = {"score": f["z"].T @ d, "bias": np.array([d.sum()])}
    dz = np.repeat(d[:, None] * w["score"], sizes, axis=0)
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), sizes))
    tg = f["t"] * f["g"]
    out["attention"] = tg.T @ de
    dt = de[:, None] * w["attention"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["attention"] * tg * (1 - f["g"])
    out["tanh"], out["gate"] = f["h"].T @ dt, f["h"].T @ dg
    dh = f["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T
    dx = dh * (1 - f["h"] ** 2)
    out["hidden"], out["hidden_bias"] = x.T @ dx, dx.sum(0)
    return out


def train(x: np.ndarray, ranges: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> AttentionModel:
    """Fit by full-batch Adam with weight decay."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    w = _start()
    w["bias"][0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for epoch in range(1, epochs + 1):
        found = forward(w, x, ranges)
        for k, g in _gradients(w, x, ranges, labels, found).items():
            g = g + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            step = first[k] / (1 - 0.9**epoch) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
            w[k] = w[k] - RATE * step
    return AttentionModel(mean, scale, w)


def score_bags(model: AttentionModel, x: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bag and attention weight of each passage."""
    if len(ranges) < 2:
        return np.zeros(0), np.zeros(0)
    found = forward(model.weights, (x - model.mean) / model.scale, ranges)
    return found["p"], found["a"]


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> AttentionModel:
    """Learn from about ``sample_rows`` labelled texts outside the held-out fold.

    Only the sample's passage vectors reach the driver: at most ``sample_rows * SAMPLE_PASSAGES``
    of them, in practice some ten per document.
    """
    sample = materialise(training_sample(docs, labels, "quality", held_out(FOLDS, FOLD), sample_rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stops = tokens.Words(), _stop_hashes()
        for batch in batches:
            x, ranges = passages(batch.column(0), words, stops)
            keep = np.flatnonzero(np.diff(ranges) <= SAMPLE_PASSAGES)
            vectors = [x[ranges[i] : ranges[i + 1]].astype("<f4").tobytes() for i in keep]
            yield pa.record_batch([batch.column(1).take(pa.array(keep)), pa.array(vectors, pa.binary())], ["label", "x"])

    rows = sample.select("text", "label").mapInArrow(encode, "label int, x binary").collect()
    # In a fixed order, so that sums do not depend on the tasks.
    rows = sorted((bytes(r["x"]), r["label"]) for r in rows)
    if not rows:
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), {k: v * 0 for k, v in _start().items()})
    bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for x, _ in rows]
    ranges = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags), ranges, np.array([y for _, y in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame, model: AttentionModel | None = None) -> DataFrame:
    """Score every row of ``docs(doc_id, text, ...)``.

    ``doc_id, held_out, score, predicted``, and ``n_passages`` with ``top_passage``, the passage with the
    greatest attention (from 0). Learns from ``labels(doc_id, quality, ...)`` unless a model is
    given; rows held out by the checksum of their id are never learned from. Only the text enters a
    score, and the whole text. A null or empty text is one passage without any words. Repeated rows
    and null ids each give their row; other columns are not used, whatever their names. Without
    labels every score is 0.5. An empty table gives an empty result.
    """
    model = model or fit_quality(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stops = tokens.Words(), _stop_hashes()
        for batch in batches:
            x, ranges = passages(batch.column(1), words, stops)
            score, attention = score_bags(model, x, ranges)
            top = [int(np.argmax(attention[a:b])) for a, b in zip(ranges[:-1], ranges[1:])]
            yield pa.record_batch([
                batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                pa.array(np.diff(ranges).astype(np.int32)), pa.array(np.array(top, np.int32)),
            ], ["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(FOLDS, FOLD).alias("held_out"))
    schema = "doc_id long, held_out boolean, score double, predicted int, n_passages int, top_passage int"
    return rows.mapInArrow(scored, schema)


def good_documents(docs: DataFrame, labels: DataFrame, model: AttentionModel | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is 0.5 or more."""
    model = model or fit_quality(docs, labels)
    text = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stops = tokens.Words(), _stop_hashes()
        for batch in batches:
            score, _ = score_bags(model, *passages(batch.column(text), words, stops))
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(kept, docs.schema)
