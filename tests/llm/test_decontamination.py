"""Containment search against all pairs."""

import random

import pytest

from custvalue.llm import decontamination
from custvalue.llm.decontamination import clean_documents, contaminated
from custvalue.llm.queries import op4_decontamination
from tests.llm.conftest import SF, shingles_of


def brute(docs, items):
    out = []
    sets = [(j, shingles_of(t)) for j, t in items]
    for i, text in docs:
        own = shingles_of(text)
        for j, item in sets:
            n = len(own & item)
            if item and 100 * n >= 75 * len(item):
                out.append((i, j, n, len(item), n / len(item)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(400)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(n))) for j, n in enumerate((3, 5, 6, 9, 20, 60, 150, 400))]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(2_000))]
        own = items[i % 8][1].split()
        for k in range(len(own)):  # from untouched to beyond recognition
            if rng.random() < (i % 5) * 0.02:
                own[k] = "other"
        at = rng.randrange(len(words) + 1)
        docs.append((i, " ".join(words[:at] + own + words[at:])))
    docs += [(500, items[0][1]), (501, items[1][1].upper()), (502, items[2][1] + "\n")]
    return docs, items


def benchmark(spark, items):
    return spark.createDataFrame([(j, t, 1) for j, t in items], "item_id long, text string, doc_id int")


def test_against_all_pairs(spark, corpus, planted):
    docs, items = planted
    pairs = brute(docs, items)
    assert len(pairs) > 40
    assert found(contaminated(corpus(docs), benchmark(spark, items))) == pairs


def test_benchmark_in_blocks(spark, corpus, planted):
    docs, items = planted
    assert found(contaminated(corpus(docs), benchmark(spark, items), block_bytes=700)) == brute(docs, items)


def test_signatures_of_long_items_are_short():
    import pyarrow as pa

    text = " ".join(f"w{n}" for n in range(5_000))
    (part,) = decontamination.item_partitions(pa.table({"id": [1], "text": [text]}), 5, 75)
    assert len(part.minima) <= 20 and part.least == 3_747


def test_clean_documents(spark, corpus, planted):
    docs, items = planted
    table = corpus([*docs, (600, None)])
    dirty = {i for i, *_ in brute(docs, items)}
    kept = clean_documents(table, benchmark(spark, items), block_bytes=700)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in [*(i for i, _ in docs), 600] if i not in dirty]


def test_odd_rows(spark, corpus, odd_rows):
    items = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""),
             (None, "word"), (4, "die die die die die die")]
    docs = corpus(odd_rows)
    assert found(contaminated(docs, benchmark(spark, items))) == brute(odd_rows, items)
    assert contaminated(corpus([]), benchmark(spark, items)).collect() == []
    assert contaminated(docs, benchmark(spark, [])).collect() == []
    assert contaminated(docs, benchmark(spark, [(1, None)])).collect() == []


def test_query_over_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(op4_decontamination(spark, SF)) == brute(docs, items)
