import hashlib
import random

import numpy as np
from loomgraph.llm import passages


def brute(rows):
    """rows by doc_id: (n_bytes, n_removed, n_spans, sha) for each."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                gone[k : k + 50] = [True] * 50
        for w in windows:
            seen.setdefault(w, i)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in passages.without_repeats(docs, **how).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    rng = random.Random(1)
    letters = lambda n, a="abcdefghijklmnop qrstuvw": "".join(rng.choices(a, k=n))
    pool = [letters(n) for n in (49, 50, 51, 60, 79, 80, 81, 100, 130, 300)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(0, max(1, len(p) - 50))
            parts += [letters(rng.randrange(0, 90)), p[a : a + rng.randrange(45, 200)]]
        rows.append((k * 3, "".join(parts)))
    rows += [(1000, "x" * 400), (1001, "x" * 180 + "y" + "x" * 90), (1002, "xy" * 200), (1003, "ab" * 30 + "xy" * 60), (1004, "é" * 100), (1005, "é" * 60), (1006, None), (1007, ""), (1008, "short")]
    rows += [(2000 + k, letters(400, "ab")) for k in range(10)] + [(2100, rows[3][1]), (2101, rows[3][1])]
    check(spark, rows, batch=4000, bucket=40)
    check(spark, rows)


def test_edge_cases(edge_docs, empty_docs):
    assert passages.without_repeats(empty_docs).collect() == []
    rows = passages.without_repeats(edge_docs, with_text=True).collect()
    assert len(rows) == 13 and all(r.n_removed == 0 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == 0 and by[8].kept_bytes.decode().startswith("word0 ")


def test_equal_identifiers_and_null(spark):
    text = "a passage that is certainly longer than fifty bytes, so it counts"
    got = passages.without_repeats(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("2", len(text)), ("None", len(text))]


def arrays_of(rng, n):
    """Entries (key, check, least) in order; few keys, so anchors and contents are shared, and some keys have two contents."""
    for _ in range(n):
        rows = {(int(a) << 38 | int(c), int(k)) for a, c, k in zip(rng.integers(0, 40, 60), rng.integers(0, 6, 60), rng.integers(0, 2, 60), strict=True)}
        rows = sorted(rows)
        yield np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.uint64), rng.integers(0, 1000, len(rows))


def test_scan_against_brute_force():
    arrays = list(arrays_of(np.random.default_rng(3), 23))
    least, at = {}, {}
    for key, check, d in arrays:
        for k, c, x in zip(key.tolist(), check.tolist(), d.tolist(), strict=True):
            least[k, c] = min(x, least.get((k, c), x))
            at.setdefault(k >> 38, []).append((k, c, x))
    for (key, check, d), got in zip(arrays, passages.scan(arrays), strict=True):
        for k, c, x, status in zip(key.tolist(), check.tolist(), d.tolist(), got.tolist(), strict=True):
            met = at[k >> 38]
            several = len({m[:2] for m in met}) > 1 and len({m[2] for m in met}) > 1
            assert status == (1 if least[k, c] < x else 2 if several else 0)


def test_levels_are_geometric_and_each_array_meets_those_that_exist():
    family, met = passages.Family(), []
    for array in map(lambda x: passages.Seen(passages.Level(*x)), arrays_of(np.random.default_rng(4), 37)):
        met.append(sum(map(len, family.levels)))
        family.take(array)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((np.diff(x.key.astype(np.int64)) >= 0).all() for x in family.levels)
    assert met[0] == 0 and min(met[1:]) > 0


def test_bytes_decide_under_equal_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    width = passages.SPAN + passages.WIDE - 1
    pool = [bytes(rng.choices(b"abcd", k=50)) for _ in range(6)]
    text = np.zeros((40, width), np.uint8)
    which = [rng.randrange(6) for _ in range(40)]
    for k, w in enumerate(which):
        text[k, :50] = np.frombuffer(pool[w], np.uint8)
    least = np.array([rng.randrange(30) for _ in range(40)])
    want = [int(min(d for d, x in zip(least, which, strict=True) if x == w) < own) for own, w in zip(least, which, strict=True)]
    args = (np.zeros(40, np.uint64), least, np.ones(40, np.int64), text)
    assert passages.compare(*args).tolist() == want
    assert passages.compare(*args, part=4).tolist() == want  # one anchor, in classes of its windows
    monkeypatch.setattr(passages, "fingerprint", lambda w, at, seed=0: np.zeros(len(at), np.uint64))
    assert passages.compare(*args).tolist() == want


def test_largest_identifier(spark):
    text = "a passage that is certainly longer than fifty bytes, so it counts"
    got = passages.without_repeats(spark.createDataFrame([(2**63 - 1, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2**63 - 1, len(text))]
