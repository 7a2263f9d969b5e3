"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from custvalue.llm.quality_rules import QUALITY_RULES_SQL


def shingles(table: str, key: str) -> str:
    """Distinct 5-word shingles per row; shorter texts are one shingle. Only A-Z are lower-cased."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
  SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM (
      SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'),
                                       '[^\x20\x09-\x0D]+') AS w
      FROM {table}))"""


JACCARD_JOIN = f"""
WITH RECURSIVE sets AS ({shingles("documents", "doc_id")}
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * o >= 75 * (p.n + q.n - o)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""

DECONTAMINATION = f"""
WITH items AS ({shingles("benchmark", "item_id")}
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ({shingles("documents", "doc_id")}) JOIN items USING (s)
  GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / CAST(n_item AS DOUBLE) AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

# Words of letters, digits and everything beyond ASCII, and the unsigned CRC-32 of a word's bytes.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CRC32 = """xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT,
                   [('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT FOR i IN range(1, length(hex({0})) // 2 + 1)]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                               lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"""


def alnum_words(table: str, key: str) -> str:
    """Each row's list of words; only A-Z are lower-cased."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{ALNUM}') AS w
  FROM {table}"""


IMPORTANCE = f"""
WITH docs AS ({alnum_words("documents", "doc_id")}
), items AS ({alnum_words("benchmark", "item_id")}
), doc_words AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL
), item_words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM items) GROUP BY ALL
), hashed AS (
  SELECT word, {CRC32.format("word")} % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words)
), s AS (SELECT bucket, sum(n) AS n FROM doc_words JOIN hashed USING (word) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM item_words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS BIGINT) + 10000 AS all_s,
         CAST(coalesce((SELECT sum(n) FROM t), 0) AS BIGINT) + 10000 AS all_t
), gains AS (
  SELECT word, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * all_s AS DOUBLE)
                                    / CAST((coalesce(s.n, 0) + 1) * all_t AS DOUBLE))) AS BIGINT) AS gain
  FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM doc_words JOIN gains USING (word) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)
           AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS taken
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= taken THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

LEXICAL_SEARCH = f"""
WITH docs AS ({alnum_words("documents", "doc_id")}
), items AS (
  SELECT DISTINCT item_id, unnest(w) AS term FROM ({alnum_words("benchmark", "item_id")})
), sizes AS (
  SELECT doc_id, len(w) AS n FROM docs WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM sizes
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scored AS (
  SELECT item_id, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_n) // all_l)))) AS BIGINT)
           AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# The others are tested against brute force, exact round trips or held-out labels in tests/llm.
ORACLE: dict[str, str] = {
    "op2_jaccard_join": JACCARD_JOIN,
    "op4_decontamination": DECONTAMINATION,
    "op9_quality_rules": QUALITY_RULES_SQL,
    "op12_term_pipeline_search": LEXICAL_SEARCH,
    "op13_importance_resampling": IMPORTANCE,
}
