"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults, threats, targets, negations, verbs of reported speech and a few helpers.
Five weighted transducers read the symbols of a clause one after the other. The negation transducer marks
what follows a negation, the report transducer what follows a verb of speech. The insult transducer weighs
an intensified insult more. The threat transducer holds a threat back until its object is known: a person
right after the verb ("I will kill you", "hurt and burn them all") makes it a targeted one, any other word
closes the place ("kill the process before you go"), and a hedge halves it. The target transducer binds
insults to a person named before them. All are composed into one machine, whose weighted outputs are
outcomes such as a plain, a targeted or a denied insult. A document's score is a logistic function of the
weight of its matched clauses per outcome.

The lexicon of insults is a short list of common ones and, learned from the labels, beginnings of
words that occur almost only in toxic documents. The weights of the outcomes are fitted, too, around
prior values that hold where labels are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise
from custvalue.llm import tokens
from custvalue.llm.labelled import held_out, training_sample

SAMPLE = 12_000  # labelled documents to learn from
LEXICON = 2_000  # most learned word beginnings, a parameter of the fit; the most frequent ones stay
PREFIXES = (4, 5, 6, 8)  # bytes
SUPPORT = 5  # toxic documents that a learned beginning needs
PURITY = 0.9
FOLDS, FOLD = 5, 0

# The word classes of the grammar.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "pathetic",
    "worthless", "disgusting", "clown", "clowns", "imbecile", "bastard", "filth", "vermin",
    "dumm", "dummkopf", "abschaum", "imbécile", "ordure", "minable", "idiota", "estúpido", "basura",
)
THREATS = (
    "kill", "killing", "hurt", "destroy", "shoot", "burn", "stab",
    "töten", "umbringen", "vernichten", "tuer", "détruire", "matar", "destruir",
)
TARGETS = (
    "you", "your", "yours", "he", "she", "they", "them", "him", "her", "his", "their", "people",
    "du", "dich", "dein", "ihr", "sie", "tu", "toi", "vous", "votre", "ils", "ustedes", "usted", "ellos",
)
NEGATIONS = (
    "not", "no", "never", "nobody", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca",
)
REPORTS = (
    "said", "says", "called", "calls", "wrote", "quoted", "claimed", "reported", "sagte", "nannte", "dit",
    "appelé", "dijo", "llamó",
)
LINKS = ("and", "or", "und", "oder", "et", "ou", "y", "o")
OPENERS = ("all", "both", "every", "each", "of", "alle", "beide", "tous", "toutes", "todos", "todas")
HEDGES = ("would", "could", "might", "if", "würde", "könnte", "wenn", "si")
INTENSIFIERS = ("such", "total", "complete", "absolute", "utter", "totaler", "völliger")
SCOPE = 3  # words after a negation that it denies
STRONGER = 1.5  # weight of an intensified insult
WEAKER = 0.5  # weight of a hedged threat
WAITING = 3  # threats that wait for one object together

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, LINK, OPENER, HEDGE, INTENSIFIER = range(11)
CLASSES = (
    (INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT),
    (LINKS, LINK), (OPENERS, OPENER), (HEDGES, HEDGE), (INTENSIFIERS, INTENSIFIER),
)
MARKED = tuple((mark, symbol) for mark in ("denied", "reported") for symbol in (INSULT, THREAT))
# Prior weights of the outcomes, and of a document without any.
PRIORS = {
    "insult": 4.5, "targeted insult": 6.0, "denied insult": 2.0, "reported insult": 2.0,
    "threat": 0.5, "targeted threat": 3.0, "denied threat": 0.0, "reported threat": 0.0,
}
OUTCOMES = tuple(PRIORS)
BIAS = -3.0


class Transducer(NamedTuple):
    """``step[state][symbol]`` is the next state and what is put out: symbols, each with a weight."""

    start: object
    step: dict


def _one(symbol: object, weight: float = 1.0) -> tuple:
    return ((symbol, weight),)


def negation() -> Transducer:
    """Denies insults and threats up to ``SCOPE`` words after a negation, within the clause."""
    step: dict = {}
    for left in range(SCOPE + 1):
        after = max(0, left - 1)
        row: dict = {s: (after, _one(s)) for s in (OTHER, TARGET, REPORT, LINK, OPENER, HEDGE, INTENSIFIER)}
        row[NEGATION] = (SCOPE, _one(OTHER))
        row[END] = (0, _one(END))
        for symbol in (INSULT, THREAT):
            row[symbol] = (after, _one(("denied", symbol) if left else symbol))
        step[left] = row
    return Transducer(0, step)


def report() -> Transducer:
    """Marks insults and threats after a verb of speech as reported, up to the clause's end."""
    step: dict = {}
    for open_ in (False, True):
        row: dict = {s: (open_, _one(s)) for s in (OTHER, TARGET, LINK, OPENER, HEDGE, INTENSIFIER)}
        row[REPORT] = (True, _one(OTHER))
        row[END] = (False, _one(END))
        for symbol in (INSULT, THREAT):
            row[symbol] = (open_, _one(("reported", symbol) if open_ else symbol))
            row["denied", symbol] = (open_, _one(("denied", symbol)))
        step[open_] = row
    return Transducer(False, step)


def insult() -> Transducer:
    """Weighs an insult ``STRONGER`` right after an intensifier."""
    step: dict = {}
    for strong in (False, True):
        row: dict = {s: (False, _one(s)) for s in (OTHER, TARGET, THREAT, END, LINK, OPENER, HEDGE, *MARKED)}
        row[INTENSIFIER] = (True, _one(OTHER))
        row[INSULT] = (False, _one(INSULT, STRONGER if strong else 1.0))
        step[strong] = row
    return Transducer(False, step)


def threat() -> Transducer:
    """Holds threats back until the words after them tell their object.

    A state is the number of waiting threats, whether a conjunction follows them, and whether the clause
    has a hedge. A conjunction keeps the place open only for another threat.
    """
    step: dict = {}
    for waiting in range(WAITING + 1):
        for linked in (False, True):
            for hedged in (False, True):
                weight = WEAKER if hedged else 1.0
                plain, bound = _one(("plain", THREAT), weight), _one(("targeted", THREAT), weight)
                free = (0, False, hedged)
                row: dict = {s: (free, plain * waiting + _one(s)) for s in (OTHER, *MARKED)}
                row[END] = ((0, False, False), plain * waiting + _one(END))
                row[HEDGE] = ((0, False, True), plain * waiting + _one(OTHER))
                row[LINK] = ((waiting, waiting > 0, hedged), _one(OTHER))
                row[OPENER] = ((waiting, linked, hedged), _one(OTHER))
                for person in (TARGET, INSULT):
                    row[person] = (free, (plain if linked else bound) * waiting + _one(person))
                full = waiting == WAITING
                row[THREAT] = ((waiting + (not full), False, hedged), plain if full else ())
                step[waiting, linked, hedged] = row
    return Transducer((0, False, False), step)


def target() -> Transducer:
    """Binds insults to a person named earlier in the clause, and names the outcomes."""
    step: dict = {}
    for seen in (False, True):
        row: dict = {OTHER: (seen, ()), TARGET: (True, ()), END: (False, ())}
        row[INSULT] = (seen, _one("targeted insult" if seen else "insult"))
        row["plain", THREAT] = (seen, _one("threat"))
        row["targeted", THREAT] = (seen, _one("targeted threat"))
        for mark, symbol in MARKED:
            row[mark, symbol] = (seen, _one(f"{mark} {'insult' if symbol == INSULT else 'threat'}"))
        step[seen] = row
    return Transducer(False, step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; weights multiply."""
    start = (first.start, second.start)
    step: dict = {}
    open_ = [start]
    while open_:
        state = open_.pop()
        if state in step:
            continue
        row = {}
        for symbol, (next_a, given) in first.step[state[0]].items():
            next_b, out = state[1], ()
            for passed, weight in given:
                next_b, results = second.step[next_b][passed]
                out += tuple((result, weight * more) for result, more in results)
            row[symbol] = ((next_a, next_b), out)
            open_.append((next_a, next_b))
        step[state] = row
    return Transducer(start, step)


def grammar() -> Transducer:
    """All five transducers as one machine, its states numbered and its outcomes as numbers."""
    whole = negation()
    for part in (report(), insult(), threat(), target()):
        whole = compose(whole, part)
    number = {state: i for i, state in enumerate(whole.step)}
    step = {
        number[state]: {
            symbol: (number[after], tuple((OUTCOMES.index(name), weight) for name, weight in out))
            for symbol, (after, out) in row.items()
        }
        for state, row in whole.step.items()
    }
    return Transducer(number[whole.start], step)


GRAMMAR = grammar()


class Lexicon:
    """Word classes as sorted hashes, and learned word beginnings."""

    def __init__(self, learned: dict[tuple[int, int], float]):
        words = tokens.Words(tokens.ALNUM)
        table: dict[int, tuple[int, float]] = {}
        for names, symbol in CLASSES:
            data, bounds = tokens.texts(pa.array(names))
            low, starts, ends, _ = words.find(data, bounds)
            for key in words.hash(low, starts, ends):
                table.setdefault(int(key), (symbol, 1.0))
        self.keys = np.array(sorted(table), np.uint64)
        self.symbols = np.array([table[int(k)][0] for k in self.keys], np.int8)
        self.sizes = tuple(sorted({size for size, _ in learned}))
        self.stems = []
        for size in self.sizes:
            own = {key: w for (s, key), w in learned.items() if s == size}
            keys = np.array(sorted(own), np.uint64)
            self.stems.append((keys, np.array([own[int(k)] for k in keys])))

    def read(self, words: tokens.Words, low, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word."""
        whole, *prefixes = words.hash_prefixes(low, starts, ends, self.sizes)
        symbols = np.zeros(len(starts), np.int8)
        weights = np.zeros(len(starts))
        for size, (keys, values), prefix in zip(self.sizes, self.stems, prefixes):
            at = np.minimum(np.searchsorted(keys, prefix), len(keys) - 1)
            hit = (keys[at] == prefix) & (ends - starts >= size)
            symbols[hit] = INSULT
            weights[hit] = np.maximum(weights[hit], values[at[hit]])
        at = np.minimum(np.searchsorted(self.keys, whole), len(self.keys) - 1)
        hit = self.keys[at] == whole
        symbols[hit], weights[hit] = self.symbols[at[hit]], 1.0
        return symbols, weights


CLAUSE_END = np.array([chr(b) in ".;:!?\n" for b in range(256)])


def clause_features(batch_text: pa.Array, lexicon: Lexicon, words: tokens.Words) -> np.ndarray:
    """Per text, the summed weight of its matches by outcome. Only clauses with a match are walked."""
    data, bounds = tokens.texts(batch_text)
    out = np.zeros((len(bounds) - 1, len(OUTCOMES)))
    insults = [name.endswith("insult") for name in OUTCOMES]
    for first, last in tokens.pieces(bounds):
        begin, end = bounds[first], bounds[last]
        low, starts, ends, ranges = words.find(data[begin:end], bounds[first : last + 1] - begin)
        symbols, weights = lexicon.read(words, low, starts, ends)
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if len(hits) == 0:
            continue
        stops = np.zeros(len(low) + 1, np.int32)
        np.cumsum(CLAUSE_END[low], out=stops[1:])
        new = np.ones(len(starts), bool)
        new[1:] = stops[starts[1:]] > stops[ends[:-1]]
        new[ranges[:-1][ranges[:-1] < len(starts)]] = True
        clauses = np.append(np.flatnonzero(new), len(starts))
        docs = np.searchsorted(ranges, hits, "right") - 1
        spans = np.searchsorted(clauses, hits, "right") - 1
        for doc, span in dict.fromkeys(zip(docs.tolist(), spans.tolist())):
            state = GRAMMAR.start
            for i in range(clauses[span], clauses[span + 1]):
                state, results = GRAMMAR.step[state][int(symbols[i])]
                for outcome, weight in results:  # a threat weighs 1, an insult what its word was learned to
                    out[first + doc, outcome] += weight * weights[i] if insults[outcome] else weight
            for outcome, weight in GRAMMAR.step[state][END][1]:
                out[first + doc, outcome] += weight
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word beginnings of labelled texts, with the number of toxic and other texts that have them."""
    words = tokens.Words(tokens.ALNUM)
    for batch in batches:
        data, bounds = tokens.texts(batch.column(0))
        labels = tokens.ids(batch.column(1))
        for first, last in tokens.pieces(bounds):
            begin, end = bounds[first], bounds[last]
            low, starts, ends, ranges = words.find(data[begin:end], bounds[first : last + 1] - begin)
            doc = np.repeat(np.arange(last - first), np.diff(ranges))
            hashes = words.hash_prefixes(low, starts, ends, PREFIXES)[1:]
            for size, keys in zip(PREFIXES, hashes):
                long_ = ends - starts >= size
                order = np.lexsort((doc[long_], keys[long_]))
                key, own = keys[long_][order], doc[long_][order]
                new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]
                key, toxic = key[new], labels[first + own[new]]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
                if len(at) == 0:
                    continue
                bad = np.add.reduceat(toxic, at)
                total = np.diff(np.append(at, len(key)))
                yield pa.record_batch([
                    pa.array(np.full(len(at), size, np.int32)), pa.array(key[at].view(np.int64)),
                    pa.array(bad), pa.array(total - bad),
                ], ["size", "key", "bad", "good"])


class ToxicModel(NamedTuple):
    learned: dict[tuple[int, int], float]
    weights: np.ndarray
    bias: float


def _fit_weights(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with Gaussian priors around ``PRIORS``, by Newton steps."""
    prior = np.append(np.array([PRIORS[name] for name in OUTCOMES]), BIAS)
    x = np.column_stack([np.log1p(features), np.ones(len(features))])
    precision = np.append(np.full(len(OUTCOMES), 1.0), 0.25)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + precision * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, lexicon_rows: int = LEXICON
) -> ToxicModel:
    """Learn lexicon and weights from about ``sample_rows`` labelled texts outside the held-out fold.

    The lexicon keeps the ``lexicon_rows`` word beginnings that most toxic texts of the sample have.
    """
    sample = materialise(training_sample(docs, labels, "toxic", held_out(FOLDS, FOLD), sample_rows))
    sums = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sums.get(1, 0), sums.get(0, 0)
    terms = sample.select("text", F.col("label").cast("long")).mapInArrow(
        _terms, "size int, key long, bad long, good long"
    )
    terms = terms.groupBy("size", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    clear = terms.where((F.col("bad") >= SUPPORT) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good"))))
    learned = {}
    for r in clear.orderBy(F.desc("bad"), "size", "key").limit(lexicon_rows).collect():
        odds = math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))
        learned[r["size"], r["key"] & (1 << 64) - 1] = min(1.0, max(0.1, odds / 4))
    lexicon = Lexicon(learned)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.Words(tokens.ALNUM)
        for batch in batches:
            found = clause_features(batch.column(0), lexicon, words)
            yield pa.record_batch([batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["label", "f"])

    rows = sample.select("text", "label").mapInArrow(features, "label int, f array<double>").collect()
    if not rows:
        return ToxicModel(learned, np.array(list(PRIORS.values())), BIAS)
    # In a fixed order, so that sums do not depend on the tasks.
    rows = sorted((tuple(r["f"]), r["label"]) for r in rows)
    weights, bias = _fit_weights(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    return ToxicModel(learned, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicModel | None = None) -> DataFrame:
    """Score every row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, score, predicted, outcomes``.

    Learns from ``labels(doc_id, toxic, ...)`` unless a model is given; rows held out by the checksum
    of their id are never learned from. Only the text enters a score. ``outcomes`` names the kinds of
    matches found. A null or empty text has none and gets the score of a document without matches.
    Repeated rows and null ids each give their row; other columns are not used, whatever their
    names. Without labels the prior weights hold. An empty table gives an empty result.
    """
    model = model or fit_toxicity(docs, labels)
    lexicon = Lexicon(model.learned)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.Words(tokens.ALNUM)
        for batch in batches:
            found = clause_features(batch.column(1), lexicon, words)
            score = 1 / (1 + np.exp(-(np.log1p(found) @ model.weights + model.bias)))
            names = [",".join(n for n, x in zip(OUTCOMES, row) if x) for row in found]
            yield pa.record_batch([
                batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                pa.array(names, pa.string()),
            ], ["doc_id", "held_out", "score", "predicted", "outcomes"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(FOLDS, FOLD).alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, outcomes string")
