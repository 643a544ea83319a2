import math
import random
from collections import Counter

import numpy as np
from loomgraph.llm import backoff, language, toxicity
from pyspark.sql import functions as F


def brute_ppm(train: bytes, text: bytes, order: int) -> float:
    """Bits of text under escape method C, straight from the counts."""
    counts = [Counter() for _ in range(order + 2)]
    padded = language.PAD + train
    for i in range(order, len(padded)):
        for m in range(1, order + 2):
            counts[m][padded[i - m + 1 : i + 1]] += 1
    after: list = [{} for _ in range(order + 2)]
    for m in range(1, order + 2):
        for g, c in counts[m].items():
            after[m].setdefault(g[:-1], {})[g[-1]] = c
    bits, padded = 0.0, language.PAD + text
    for i in range(order, len(padded)):
        for m in range(order + 1, 0, -1):
            nxt = after[m].get(padded[i - m + 1 : i])
            if nxt is None:
                continue
            n, q = sum(nxt.values()), len(nxt)
            if padded[i] in nxt:
                bits -= math.log2(nxt[padded[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    en, de = "the cat sat on the mat and the hat " * 3, "der hund und die katze sind im haus " * 3
    names, model = language.fit([("en", en), ("de", de)])
    texts = ["the dog sat", "und der mat", "zzz", "é the", ""]
    got = language.code_lengths(model, texts)
    for k, lang in enumerate(names):
        want = [brute_ppm({"en": en, "de": de}[lang].encode(), t.encode(), language.ORDER) for t in texts]
        assert np.allclose(got[:, k], want, rtol=1e-4)


def test_long_texts_in_chunks():
    _, model = language.fit([("en", "the cat sat on the mat"), ("de", "der hund und die katze")])
    text = "the katze sat und die mat " * 400
    assert np.allclose(language.code_lengths(model, [text], chunk=1000), language.code_lengths(model, [text]), rtol=1e-5)


def corpus(n=400):
    rng = random.Random(2)
    words = {"en": "the of and to in that was for with his they from this have".split(), "de": "der die und das nicht mit sich auf für ist dem den von ein".split()}
    bad = "nastyword vileterm".split()
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        w = [rng.choice(words[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randrange(20, 80))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "."])
        rows.append((k, " ".join(w), lang, "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_language_held_out_accuracy(docs_of, empty_docs):
    rows, _ = corpus()
    rows += [(9000, None, "en", "s"), (9001, "123 !!", "en", "s"), (9002, "", "de", "s"), (None, "the of and", "en", "s")]
    got = language.identify(docs_of(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (9000, 9001, 9002))
    assert by[None].held_out and by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert language.identify(empty_docs).collect() == []


def test_no_labelled_language(docs_of):
    assert {r.lang_pred for r in language.identify(docs_of([(1, "abc", None, "s"), (2, "abc", None, "s")])).collect()} == {"und"}


def test_every_labelled_language_is_learned(docs_of):
    rng = random.Random(4)
    rows = []
    for k in range(70):  # more than 64, each with an alphabet of its own
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(10 * k + j, " ".join("".join(rng.choices(letters, k=5)) for _ in range(20)), f"l{k:02}", "s") for j in range(8 + (k > 5))]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs_of(rows)).collect()}
    assert {k for k, _, lang, _ in rows if got[k] != lang} == set()


def test_long_and_null_texts_hide_no_language(docs_of):
    rows = [(k, "der hund und die katze " * 2000, "de", "s") for k in range(6)]
    rows += [(100 + k, "the cat sat on the mat", "en", "s") for k in range(6)]
    rows += [(200 + k, None if k % 20 else "le chat est sur la table", "fr", "s") for k in range(200)]
    got = language.identify(docs_of(rows), n=2).collect()
    truth = {r[0]: r[2] if r[1] else "und" for r in rows}
    assert {r.doc_id for r in got if r.lang_pred != truth[r.doc_id]} == set()


def test_toxicity_held_out(spark, docs_of, empty_docs):
    rows, labels = corpus(600)
    rows += [(9000, None, None, None), (9001, "", "en", "s"), (None, "the of nastyword", "en", "s")]
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(rows), marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = toxicity.clean(docs_of(rows), marks)
    assert out.columns == docs_of(rows).columns
    assert toxicity.toxicity(empty_docs, marks).collect() == []
    none = toxicity.toxicity(docs_of(rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}


def test_few_toxic_labels_give_no_constant(spark, docs_of):
    rows, labels = corpus(240)
    learnable = {r.id for r in spark.range(240).where(toxicity.remainder(F.col("id"), 4) != 2).collect()}
    truth = dict(labels)
    for few in (1, 2, 5, 12):
        toxic = [k for k, y in labels if y and k in learnable][:few]
        marks = spark.createDataFrame([(k, y) for k, y in labels if not y or k in toxic], "doc_id long, toxic int")
        got = toxicity.toxicity(docs_of(rows), marks).collect()
        score = {y: [r.score for r in got if truth[r.doc_id] == y and r.doc_id not in toxic] for y in (0, 1)}
        assert len({r.score for r in got}) > 100 and np.median(score[1]) > np.median(score[0])
        assert all(0 <= r.score <= 1 for r in got)


def test_long_toxic_labels_are_learned(spark, docs_of):
    rows, labels = corpus(120)
    rows = [(k, t + " nastyword" * 30 if y else t, lang, s) for (k, t, lang, s), (_, y) in zip(rows, labels)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert len({r.score for r in toxicity.toxicity(docs_of(rows), marks, most=500).collect()}) > 60


def test_shared_counts_have_four_bytes_of_all_documents(docs_of):
    texts = ["The rareword, the cat", "rareword dog", "", None, "the the the"]
    want = Counter()
    for t in texts:
        for w in toxicity.distinct_words(t or ""):
            padded = b" " * (toxicity.LONGEST - 1) + w + b" "
            want.update(int.from_bytes(padded[i - 3 : i + 1], "big") for i in range(toxicity.LONGEST - 1, len(padded)))
    g, n = toxicity.shared_counts(docs_of([(k, t, None, "s") for k, t in enumerate(texts)]), "text")
    assert dict(zip(g.tolist(), n.tolist(), strict=True)) == want


def test_kneser_ney_sums_to_one():
    grams = np.array(sorted({int.from_bytes(b"ab" + bytes([c]), "big") for c in b"abc"}), np.uint64)
    counts = np.array([[3, 1], [2, 1], [1, 0]])
    tables = {3: (grams, counts), 2: backoff.continuations(grams, counts, 2)}
    tables[1] = backoff.continuations(*tables[2], 1)
    model = backoff.kneser_ney(tables)
    stream = np.frombuffer(b"".join(b"ab" + bytes([c]) for c in range(256)), np.uint8)
    bits = model.score(stream, np.arange(2, len(stream), 3))
    assert np.allclose(np.exp2(-bits.astype(float)).sum(0), 1, atol=1e-3)


def test_expressions_against_brute_force():
    """Probabilities of words and pairs straight from counts; those of all words and a remainder for the unseen add up to 1."""
    rng = random.Random(6)
    vocabulary = [f"w{k}".encode() for k in range(12)]
    texts = [[" ".join(w.decode() for w in rng.choices(vocabulary, k=9)) for _ in range(20)] for _ in range(2)]
    made = [toxicity.once(t) for t in texts]
    words = sorted(set(made[0][0]) | set(made[1][0]))
    pairs = sorted(set(made[0][1]) | set(made[1][1]))
    left, right = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    e = toxicity.Expressions(toxicity.word_hash(words), np.array([[m[0][w] for m in made] for w in words]), left, right, np.array([[m[1][p] for m in made] for p in pairs]))
    index, pair_index, first_index = e.index()
    base = np.full((len(words), 2), 0.01)
    got = e.of_words(index.lookup(toxicity.word_hash(words)), base)
    for c, (n, two) in enumerate(made):
        total, d = sum(n.values()), toxicity.DISCOUNT
        want = [max(n[w] - d, 0) / total + d * len(n) / total * 0.01 for w in words]
        assert np.allclose(got[:, c], want)
        assert math.isclose(sum(max(n[w] - d, 0) / total for w in words) + d * len(n) / total, 1)
        h = dict(zip(toxicity.word_hash(words).tolist(), range(len(words)), strict=True))
        for v, w in pairs[:40]:
            row, at = pair_index.lookup(toxicity.pair_hash(*(np.array([x], np.uint64) for x in (v, w)))), first_index.lookup(np.array([v], np.uint64))
            after = {b: k for (a, b), k in two.items() if a == v}
            lower = got[h[w]]
            total = sum(after.values())
            p = max(after.get(w, 0) - d, 0) / total + d * len(after) / total * lower[c] if total else lower[c]
            assert math.isclose(e.of_pairs(row, at, lower[None, :])[0, c], p)


def test_pairs_tell_where_words_do_not(spark, docs_of):
    rng = random.Random(3)
    plain = "the of and to in that was for with his they from this have".split()
    rows, labels = [], []
    for k in range(300):
        w = [rng.choice(plain) for _ in range(30)]
        at = rng.randrange(28)
        w[at : at + 2] = ["cold", "fish"] if k % 3 == 0 else ["fish", "cold"]
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(k % 3 == 0)))
    got = toxicity.toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) / len(held) > 0.95


def test_language_model_is_bounded():
    texts = [("en", "the cat sat on the mat " * 5), ("de", "der hund und die katze " * 5)]
    names, whole = language.fit(texts)
    _, small = language.fit(texts, most=4000)
    size = lambda m: sum(len(g) for g in m.grams[1:])
    assert size(small) < size(whole) and len(small.grams) == len(whole.grams)
    bits = language.code_lengths(small, ["the cat", "die katze"])
    assert [names[k] for k in bits.argmin(1)] == ["en", "de"]
