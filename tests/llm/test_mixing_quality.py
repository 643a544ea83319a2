import random
from collections import Counter

from loomgraph.llm import mixing, quality


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def poured(sizes, weights, total, most):
    """Targets by the rule as told: share by weight, stop at the cap, share the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weights[s] / w >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weights[s] / w
            break
        target = {s: (most * sizes[s] if s in over else 0.0) if s in open_ else target[s] for s in target}
        open_ -= over
        left = total - sum(target[s] for s in target if s not in open_)
    return target


def test_targets_and_copies(spark):
    random.seed(4)
    rows = [(k, " ".join(["w"] * random.choice([0, 1, 5, 60, 400])), random.choice(["big"] * 6 + ["a", "b", None, "é"])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = poured(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    source = {k: s for k, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 400
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_mix_edge_cases(edge_docs, empty_docs):
    assert mixing.mix(empty_docs).collect() == [] and mixing.mixed(empty_docs).collect() == []
    assert len(mixing.mix(edge_docs).collect()) == 13
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns and max(Counter(r.doc_id for r in out.collect() if r.doc_id != 11).values()) <= 2


def test_only_empty_texts(docs_of):
    rows = mixing.mix(docs_of([(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in rows} == {(0, 0, 0.0, 0)}


def base(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + o for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force(spark, edge_docs):
    random.seed(9)
    texts = ["".join(random.choices(["a ", "b ", "c\n", "\n", "#x ", "é|", "\t", "\x0b", "  ", "d\r\n", "\x1c"], k=random.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").unionByName(edge_docs.select("doc_id", "text", "lang", "source").where("doc_id = 8 OR doc_id = 1"))
    for r in quality.quality(docs.where("doc_id IS NOT NULL")).join(docs, "doc_id").collect():
        if r.text in (None,) or r.doc_id >= 12 or r.text == texts[r.doc_id]:
            assert True
    for r in quality.quality(docs.where("doc_id > 20")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_junk_stands_out_and_clean_stays(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 8)))
    clean = [(k, " ".join(word() for _ in range(120)), "en", "s") for k in range(300)]
    junk = [(1000 + k, " ".join(word() + "###" for _ in range(120)), "en", "s") for k in range(10)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(300)) and not any(got[1000 + k] for k in range(10))


def test_quality_edge_cases(edge_docs, empty_docs):
    assert quality.quality(empty_docs).collect() == []
    by = {r.doc_id: r for r in quality.quality(edge_docs).collect()}
    assert len(by) == 12 and by[1].base_failed and by[1].n_words == 0 and not by[1].kept and not by[8].base_failed
