"""Pass-through operators on columns whose names clash with anything."""

from collections import Counter

import pytest
from loomgraph.llm import exact_dedup, mixing, near_dedup, packing, quality, tokens, toxicity

NAMES = ["doc_id", "text", "lang", "source", "__lg_key", "__lg_n", "__lg_score", "meta.url", "TEXT", "k", "key", "c0", "c1", "copies", "rid", "score"]


@pytest.fixture
def odd_docs(spark):
    rows = [(k, f"Some words number {k // 2} are here and stay as they are", "en", "ab"[k % 2], *[f"{n}-{k}" for n in NAMES[4:]]) for k in range(12)]
    rows += [(12, None, None, None, *["x"] * 12), (12, None, None, None, *["x"] * 12), (None, "no identifier", "en", "a", *["y"] * 12), (None, "no identifier", "en", "a", *["y"] * 12)]
    types = ["long", *["string"] * (len(NAMES) - 1)]
    docs = spark.createDataFrame(rows, ", ".join(f"x{k} {t}" for k, t in enumerate(types))).repartition(3)
    return docs.toDF(*NAMES)


def whole(rows):
    return all(r[4:] == (tuple(f"{n}-{r[0]}" for n in NAMES[4:]) if r[0] is not None and r[0] < 12 else ("x",) * 12 if r[0] == 12 else ("y",) * 12) for r in map(tuple, rows))


def test_keep_distinct(odd_docs):
    out = exact_dedup.keep_distinct(odd_docs)
    rows = out.collect()
    assert out.columns == NAMES and whole(rows)
    assert Counter(r[0] for r in rows) == Counter([1, 3, 5, 7, 9, 11, 12, None])


def test_keep_one(odd_docs):
    out = near_dedup.keep_one(odd_docs)
    rows = out.collect()
    assert out.columns == NAMES and whole(rows)
    assert Counter(r[0] for r in rows) == Counter([0, 2, 4, 6, 8, 10, 12, 12, None])


def test_mixed(odd_docs):
    out = mixing.mixed(odd_docs)
    rows = out.collect()
    assert out.columns == NAMES and whole(rows)
    want = Counter()
    for r in mixing.mix(odd_docs).collect():
        want[r[0]] += r.copies
    assert Counter(r[0] for r in rows) == +want


def test_clean(odd_docs, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    out = toxicity.clean(odd_docs, labels, threshold=2.0)
    rows = out.collect()
    assert out.columns == NAMES and whole(rows) and len(rows) == 16


def test_others_read_the_named_column(odd_docs):
    assert {r.n_tokens > 0 for r in tokens.token_counts(odd_docs).where("doc_id < 12").collect()} == {True}
    assert packing.pack(odd_docs).count() == 16
    assert {r.n_words for r in quality.quality(odd_docs).where("doc_id < 12").collect()} == {11}
