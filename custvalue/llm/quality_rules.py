"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "for", "was", "it",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "pour", "dans",
    "der", "die", "das", "und", "ein", "eine", "ist", "nicht", "mit", "von", "zu", "den",
    "el", "los", "las", "y", "en", "por", "con", "una", "su", "no", "lo",
)


class Rule(NamedTuple):
    """``low <= 100 * value / base <= high``; a missing bound does not limit."""

    name: str
    value: str
    base: str
    low: int | None
    high: int | None


# Whole per cent, so that no rounding decides.
RULES = (
    Rule("word_length", "word_chars", "n_words", 150, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "one", 200, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 30),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row breaks, comma-joined in the order of the table."""
    broken = []
    for rule in rules:
        value = F.col(rule.value) * 100
        base = F.lit(1) if rule.base == "one" else F.col(rule.base)
        tests = []
        if rule.low is not None:
            tests.append(value < base * rule.low)
        if rule.high is not None:
            tests.append(value > base * rule.high)
        outside = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        broken.append(F.when(outside, F.lit(rule.name)))
    return F.concat_ws(",", *broken)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` reduced to ``doc_id`` and the counts that the rules use."""
    whole = F.coalesce(F.col(text), F.lit(""))
    solid = F.btrim(whole, F.lit(SPACES))
    words = F.split(solid, "[\\x20\\x09-\\x0D]+")
    split = docs.select(
        "doc_id",
        F.when(solid != "", words).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.char_length(F.translate(whole, SPACES, "")).alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).alias("n_symbols"),
    )
    # 3-word windows in the order of their hashes, so that equal ones are neighbours.
    at = lambda name, i: F.get(F.col(name), i)
    window = lambda w, i: F.struct(
        F.xxhash64(w, at("words", i + 1), at("words", i + 2)).alias("h"), i.alias("i")
    )
    windows = F.when(
        F.size("words") >= 3, F.slice(F.transform("words", window), F.lit(1), F.size("words") - 2)
    )
    split = split.select("*", F.sort_array(windows).alias("windows"))
    equal = lambda x, i: (
        (x["h"] == at("windows", i - 1)["h"]) | (x["h"] == at("windows", i + 1)["h"])
    )
    repeated = F.transform(F.filter("windows", equal), lambda x: x["i"])
    split = split.select("*", F.sort_array(repeated).alias("repeated"))
    # Words in the union of the repeated windows: each adds three, or fewer if the next overlaps.
    added = lambda x, i: F.least(F.lit(3), F.coalesce(at("repeated", i + 1) - x, F.lit(3)))
    covered = F.aggregate(F.transform("repeated", added), F.lit(0), lambda total, x: total + x)
    stops = F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``broken_rules`` and ``kept``.

    A document fails outright with fewer than 50 words, or if more than half of its words lie in
    3-word windows that occur twice in it. Otherwise it is kept if it breaks no rule of the table. A
    null or empty text has no words and fails. Repeated rows and null ids pass through; other
    columns are not used, whatever their names. An empty table gives an empty result. Equal windows
    are found by 64-bit hashes.
    """
    found = measures(docs, text)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    verdict = found.select("*", failed.alias("base_failed"), compiled(rules).alias("broken_rules"))
    kept = ~F.col("base_failed") & (F.col("broken_rules") == "")
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), "n_lines", "n_stop_words", "broken_rules",
    )


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    broken = []
    for rule in rules:
        base = "1" if rule.base == "one" else rule.base
        tests = []
        if rule.low is not None:
            tests.append(f"{rule.value} * 100 < {base} * {rule.low}")
        if rule.high is not None:
            tests.append(f"{rule.value} * 100 > {base} * {rule.high}")
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END")
    return f"concat_ws(',', {', '.join(broken)})"


QUALITY_RULES_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM base
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), found AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words
  FROM parts LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {_sql_rules(RULES)} AS broken_rules
  FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_stop_words AS BIGINT) AS n_stop_words, broken_rules
FROM judged
"""
