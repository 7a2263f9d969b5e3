"""License scans by diagonal voting.

Every run of ``k`` words of every text is hashed, and Spark joins the hashes to the positions at
which the templates have them. A hit votes for the diagonal ``word position - template position``:
an unbroken copy of a template puts all its votes on one diagonal, and a lost or added word moves the
rest to a neighbouring one. Votes are gathered by diagonal, and a diagonal is merged with those up to
``drift`` beyond it into a span. A span is verified by its order: it holds the longest sequence of its hits
in which both the template position and the word position grow. So a template position counts once, however
often the text repeats its words, and a span is at most ``drift`` words longer than its template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custvalue.llm import tokens


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False  # a phrase that counts wherever its words stand consecutively


# License names and the wording of notices.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
             " software and associated documentation files"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies"
             " or substantial portions of the software"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy"
             " of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of"
             " the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are"
             " permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc", "this work is licensed under a creative commons attribution"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or"
             " without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
COVERAGE = 0.75  # share of a template's k-grams that a span must hold
DRIFT = 3  # words lost or added that a span may bridge in all

ROWS = "row long, doc_id long, n_words long, pos long, pair long, triple long"


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of two and of three consecutive words, one per first word of a pair."""
    factors = tokens.numbers(3, 31)
    pair = words[:-1] * factors[0] + words[1:] * factors[1]
    triple = np.zeros_like(pair)
    triple[:-1] = pair[:-1] + words[2:] * factors[2]
    return tokens.mix(pair).view(np.int64), tokens.mix(triple).view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All word pairs and triples, and per document one row without position for its word count."""
    words = tokens.Words(tokens.ALNUM)
    for batch in batches:
        data, bounds = tokens.texts(batch.column(2))
        for first, last in tokens.pieces(bounds):
            begin, end = bounds[first], bounds[last]
            low, starts, ends, ranges = words.find(data[begin:end], bounds[first : last + 1] - begin)
            counts = np.diff(ranges)
            head = batch.slice(first, last - first)
            none = pa.nulls(last - first, pa.int64())
            yield pa.record_batch([
                head.column(0), head.column(1).cast(pa.int64()), pa.array(counts), none, none, none,
            ], ["row", "doc_id", "n_words", "pos", "pair", "triple"])
            if len(starts) < 2:
                continue
            pair, triple = _grams(words.hash(low, starts, ends))
            doc = np.repeat(np.arange(last - first), counts)
            inside = doc[1:] == doc[:-1]  # both words in one document
            pos = (np.arange(len(doc)) - ranges[doc])[:-1][inside]
            rows = tokens.ids(head.column(0))[doc[:-1][inside]]
            triple[ranges[1:][counts >= 2] - 2] = 0  # no third word in the document
            none = pa.nulls(len(pos), pa.int64())
            yield pa.record_batch([
                pa.array(rows), none, none, pa.array(pos), pa.array(pair[inside]), pa.array(triple[inside]),
            ], ["row", "doc_id", "n_words", "pos", "pair", "triple"])


def template_index(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row per k-gram position: pairs for templates of two words, triples for longer ones."""
    words = tokens.Words(tokens.ALNUM)
    rows = []
    for number, template in enumerate(templates):
        data, bounds = tokens.texts(pa.array([template.text]))
        low, starts, ends, _ = words.find(data, bounds)
        if len(starts) < 2:
            raise ValueError(f"a template needs two words: {template.text!r}")
        pair, triple = _grams(words.hash(low, starts, ends))
        if len(starts) == 2:
            rows.append((int(pair[0]), None, number, 0, 1, template.base))
        else:
            grams = len(starts) - 2
            rows += [(int(pair[i]), int(triple[i]), number, i, grams, template.base) for i in range(grams)]
    schema = "t_pair long, t_triple long, template int, t_pos int, grams int, base boolean"
    return spark.createDataFrame(rows, schema)


def in_order(hits: list[tuple[int, int]]) -> int:
    """The most hits ``(template position, shift)`` of which position and position + shift grow together."""
    best: dict[int, list[tuple[int, int]]] = {}  # by shift: positions and the longest sequence up to them
    for place in sorted({t for t, _ in hits}):
        found = []
        for shift in (s for t, s in hits if t == place):
            before = 0
            for other, ends in best.items():
                last = place - max(1, other - shift + 1)  # from here back the words come before, too
                before = max([before, *[n for t, n in ends if t <= last][-1:]])
            found.append((shift, before + 1))
        for shift, n in found:
            ends = best.setdefault(shift, [])
            ends.append((place, max(n, ends[-1][1]) if ends else n))
    return max((ends[-1][1] for ends in best.values()), default=0)


SPANS = (
    "row long, template int, diagonal long, doc_id long, n_words long, places int, base boolean, held double"
)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of the template that the span from each diagonal on holds."""
    for batch in batches:
        near, grams, base = batch.column("near"), batch.column("grams").to_pylist(), batch.column("base").to_pylist()
        held, places = [], []
        for i, n in enumerate(grams):
            if n is None:
                held.append(None)
                places.append(0)
                continue
            hits = [(t, d["diagonal"]) for d in near[i].as_py() for t in d["held"]]
            if base[i]:  # its words stand consecutively
                own = min(d for _, d in hits)
                places.append(int(sum(d == own for _, d in hits) == n))
                held.append(float(places[-1]))
            else:
                places.append(0)
                held.append(in_order(hits) / n)
        kept = [batch.column(c) for c in ("row", "template", "diagonal", "doc_id", "n_words")]
        kept += [pa.array(places, pa.int32()), batch.column("base"), pa.array(held, pa.float64())]
        yield pa.record_batch(kept, [f.split()[0] for f in SPANS.split(", ")])


def license_scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE, drift: int = DRIFT
) -> DataFrame:
    """One row per row of ``docs``: word count, base places, labels and a score.

    ``n_base`` counts the places where the words of a base phrase stand consecutively, ``first_word``
    and ``last_word`` are the smallest and largest start (null without one), ``base_labels`` the
    labels of these phrases. ``labels`` adds those of templates of which a span holds the share ``coverage``:
    so many of its k-grams in their order, on diagonals at most ``drift`` apart. ``score`` is the best share
    that a span holds of any template, 1 for a base phrase. Words are lower-cased runs of letters, digits and non-ASCII characters.

    A null or empty text has no words, labels are then empty strings and the score is 0. Repeated
    rows and null ids each give their row; other columns are not used, whatever their names. An
    empty table gives an empty result. Only the templates are broadcast: a few hundred positions.
    """
    index = template_index(docs.sparkSession, templates)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    grams = rows.mapInArrow(_windows, ROWS)
    hit = (F.col("pair") == F.col("t_pair")) & (F.col("t_triple").isNull() | (F.col("triple") == F.col("t_triple")))
    votes = grams.join(F.broadcast(index), hit, "left").where("template IS NOT NULL OR pos IS NULL")
    # Texts without any hit keep their own row (template null).
    diagonals = votes.groupBy("row", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.first("grams").alias("grams"), F.first("base").alias("base"), F.collect_set("t_pos").alias("held"),
    )
    # A span holds at most `drift` + 1 diagonals, and of each at most the template's positions.
    beyond = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, drift)
    near = F.collect_list(F.struct("diagonal", "held")).over(beyond)
    spans = diagonals.withColumn("near", near).drop("held").mapInArrow(_verified, SPANS)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    known = F.when(F.col("template").isNotNull(), label)
    place = F.when(F.col("places") > 0, F.col("diagonal"))
    based = F.when(F.col("places") > 0, known)
    found = F.when(F.col("base"), based).when(F.col("held") >= coverage, known)
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  labels only
    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        sorted_set(based).alias("base_labels"), sorted_set(found).alias("labels"),
        F.coalesce(F.max("held"), F.lit(0.0)).alias("score"),
    ).drop("row")


def words_of(text: str) -> list[str]:
    """The words of one text, for small inputs."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
