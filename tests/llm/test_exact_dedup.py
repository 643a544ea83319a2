import hashlib
import random

from loomgraph.llm import exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_edge_cases(edge_docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(edge_docs).collect()}
    rows = exact_dedup.exact_dedup(edge_docs).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == by[2].keep_id == 3 and by[3].group_size == 3 and by[3].kept and not by[1].kept
    assert by[4].group_size == 1
    assert by[5].keep_id == by[6].keep_id == 7
    assert by[9].keep_id == 9 and by[10].keep_id == 10  # only A-Z is lowered
    assert sum(r.kept for r in rows if r.doc_id == 11) == 1
    assert by[8].text_sha256 == hashlib.sha256(lower(rows_text(edge_docs, 8)).encode()).hexdigest()
    assert got


def rows_text(docs, ident):
    return docs.where(f"doc_id = {ident}").first().text


def test_keep_distinct_keeps_columns(edge_docs):
    kept = exact_dedup.keep_distinct(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 7, 8, 9, 10, 11]


def test_empty(empty_docs):
    assert exact_dedup.exact_dedup(empty_docs).collect() == []
    assert exact_dedup.keep_distinct(empty_docs).collect() == []


def test_many_runs_against_brute_force(spark):
    random.seed(3)
    rows = [(k, random.choice(["a", "B", "b", "hot", "hot", "HOT", f"t{k}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(37)
    best, size = {}, {}
    for k, t in rows:
        best[lower(t)] = max(best.get(lower(t), -1), k)
        size[lower(t)] = size.get(lower(t), 0) + 1
    got = exact_dedup.exact_dedup(docs, fan_in=4).collect()
    text = dict(rows)
    assert len(got) == 400
    for r in got:
        t = lower(text[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept) == (best[t], size[t], r.doc_id == best[t])
