import random
from collections import Counter

import numpy as np
import pytest
from loomgraph.llm import near_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(rows))], [len(s) for s in sets]


def family(rng, n, size, rate):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in range(size):
            if rng.random() < rate:
                w[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for size, n, rate in ((200, 40, 0.02), (120, 30, 0.03), (400, 20, 0.01), (60, 30, 0.05)) for t in family(rng, n, size, rate)]
    shared = " ".join(f"p{k}" for k in range(120))
    texts += [shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)] + ["A b", "a  B", "c", "", None, " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, sizes = brute(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert [got[k].component_id for k, _ in rows] == want
    assert [got[k].n_shingles for k, _ in rows] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_nodes_branch_and_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIMIT", 8)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 60, 150, 0.02) + family(rng, 40, 150, 0.025)))
    want, _ = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == want


def test_edge_cases(edge_docs, empty_docs):
    assert near_dedup.near_duplicates(empty_docs).collect() == [] and near_dedup.keep_one(empty_docs).collect() == []
    by = {r.doc_id: r for r in near_dedup.near_duplicates(edge_docs).collect()}
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[5].component_id == by[7].component_id == 5 and by[9].component_id == 9
    assert by[8].n_shingles == 29_996
    out = near_dedup.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 3, 4, 5, 8, None, 9, 10, 11])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, near_dedup.components(links).collect()))
    assert all(got[k] == 0 for k in range(51)) and got[100] == got[101] == 100


@pytest.mark.parametrize("similarity", [0.76, 0.9])
def test_sketch_estimates(similarity):
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, int(2000 * similarity), dtype=np.uint64)
    rest = rng.integers(0, 2**63, (2, 2000 - len(common)), dtype=np.uint64)
    n = len(common) / (len(common) + 2 * rest.shape[1])
    a, b = near_dedup.minwise([np.concatenate([common, rest[0]]), np.concatenate([common, rest[1]])])
    assert abs((a == b).mean() - n) < 0.2
