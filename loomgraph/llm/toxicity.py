"""Toxicity from class-conditional Kneser-Ney models.

Toxic and ordinary documents each have a Kneser-Ney model of expressions: words,
and pairs of words that follow each other, counted once a document, so repetition
adds no evidence. Pairs back off to words, and words to a byte model of the class
(an interpolated Kneser-Ney model whose grams of `LONGEST` bytes carry counts and
whose shorter ones carry continuation counts). Below `SHARED` + 1 bytes both
classes back off to one set of counts, gathered from the distinct words of all
documents, labelled or not, so what neither class has seen says the same under
both. An expression that labelled documents have fewer than twice is left to the
byte models, a longest gram that they have once to the shorter ones.

A document's two log-likelihoods over its distinct words are compared per symbol
(length-normalised), and so are those of its most telling expressions, as one
insult says little about the mean of a long text. A logistic curve over these,
fitted on out-of-fold scores, makes them a probability: the labelled sample is
dealt into FOLDS parts, each is measured by models of the others, and the models
in use have the counts of all. With fewer than `FEW` labelled documents of a class
a fixed prior takes the curve's place.

Labels are learned only from rows with crc32(doc_id) mod 4 other than 2. The
labelled sample is bounded: `SAMPLE` documents a class, first in the order of a
hash of doc_id among those with a text, the first `SAMPLE_BYTES` characters of
each, and `CURVE` of them a class for the curve. The shared counts cover
all documents and are added up by a distributed aggregation; the table of shared
grams has no limit, grows with the different grams of the corpus, and is
broadcast with the model (it is not sharded).

Defined results: null and empty texts get the score of a text with no evidence;
a null doc_id is held out; of repeated labels of a doc_id the highest counts, a
null label none; without rows of both classes every score is the share of toxic
labels (0 without labels); repeated rows are scored as they are; empty tables
give empty results; other columns are not read by `toxicity` and pass through
`clean` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff
from .common import documents, frozen, positional, ship
from .language import remainder
from .tables import HashIndex

LONGEST, SHARED = 6, 4
SAMPLE, SAMPLE_BYTES, CURVE = 5000, 16_384, 1500
THRESHOLD = 0.3
MEMORY = 500_000
FOLDS, FEW = 5, 25
#: Without a curve, SYMBOLS symbols of evidence stand against the prior, and the best expression beyond DOUBT bits.
PRIOR, SYMBOLS, DOUBT = 0.1, 20, 4
DISCOUNT = 0.75
ENOUGH, TOP = 16, 3  # expressions that are looked at by themselves
_PAD = b" " * (LONGEST - 1)
_EDGE = b".,!?;:|\"'()#*$%&<>"
_RUN = re.compile(r"\S+")


def distinct_words(text: str) -> set[bytes]:
    raw = {m.group() for m in _RUN.finditer(text)} if len(text) > 2_000_000 else set(text.split())
    return {w.lower().encode().strip(_EDGE) for w in raw} - {b""}


def all_words(text: str) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode().split()) if w]


def stream_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in one array, each between padding and a space; the positions of their bytes and that space; their sizes."""
    stream = np.frombuffer(b"".join(x for w in words for x in (_PAD, w, b" ")), np.uint8)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    keep = np.ones(len(stream), bool)
    starts = np.cumsum(sizes + LONGEST - 1) - sizes - LONGEST + 1
    keep[(starts[:, None] + np.arange(LONGEST - 1)).ravel()] = False
    return stream, np.flatnonzero(keep), sizes


def grams_of(words: list[bytes], m: int) -> np.ndarray:
    stream, at, _ = stream_of(words)
    return backoff.codes(stream, m)[m][at]


def make_model(grams: np.ndarray, counts: np.ndarray, shared: tuple[np.ndarray, np.ndarray]) -> backoff.Backoff:
    """grams of LONGEST bytes with a column (toxic, ordinary) of counts; shared: grams of SHARED bytes and counts."""
    tables = {LONGEST: backoff._group(grams, counts)}
    for m in range(LONGEST - 1, 0, -1):
        if m == SHARED:
            tables[m] = shared[0], np.repeat(shared[1][:, None], 2, 1)
        else:
            tables[m] = backoff.continuations(*tables[m + 1], m)
    return backoff.kneser_ney(tables)


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def once(texts: list[str]) -> tuple[dict, dict]:
    """In how many of the texts each word is, and each pair of hashes of neighbouring words."""
    words, pairs = Counter(), Counter()
    for t in texts:
        found = all_words(t)
        words.update(set(found))
        h = word_hash(found).tolist()
        pairs.update(set(zip(h, h[1:], strict=False)))
    return words, pairs


class Expressions:
    """Counts a class (columns: toxic, ordinary) of words and pairs, in how many documents each is, and of pairs by first word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray):
        seen = counts.sum(1) > 0
        self.words, self.counts = words[seen], counts[seen]
        self.total, self.kinds = self.counts.sum(0).astype(float), (self.counts > 0).sum(0).astype(float)
        seen = pairs.sum(1) > 0
        left, right, self.pair_counts = left[seen], right[seen], pairs[seen]
        self.pairs = pair_hash(left, right)
        self.first, at = np.unique(left, return_inverse=True)
        self.first_total, self.first_kinds = np.zeros((len(self.first), 2)), np.zeros((len(self.first), 2))
        np.add.at(self.first_total, at, self.pair_counts)
        np.add.at(self.first_kinds, at, self.pair_counts > 0)

    def index(self) -> tuple[HashIndex, HashIndex, HashIndex]:
        return HashIndex(self.words), HashIndex(self.pairs), HashIndex(self.first)

    def of_words(self, row: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probabilities a class of words in these rows (-1: not counted); base: those of the byte models."""
        n = np.where((row >= 0)[:, None], self.counts[row], 0) if len(self.words) else np.zeros_like(base)
        total, kinds = np.maximum(self.total, 1), np.where(self.total > 0, self.kinds, 1)
        return np.maximum(n - DISCOUNT, 0) / total + np.where(self.total > 0, DISCOUNT * kinds / total, 1) * base

    def of_pairs(self, row: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probabilities a class of second words after first ones; base: those of the words alone."""
        total, kinds = self.first_total[first], self.first_kinds[first]
        more = np.maximum(self.pair_counts[row] - DISCOUNT, 0) / np.maximum(total, 1)
        return more + np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1) * base


def told(odds: np.ndarray) -> np.ndarray:
    """The bits by which probabilities (toxic, ordinary) speak for toxic."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log2(odds[:, 0]) - np.log2(odds[:, 1]), nan=0.0, posinf=1000.0, neginf=-1000.0)


class Scorer:
    """What each text says: features(), a row a text, and its symbols."""

    def __init__(self, model: backoff.Backoff, expressions: Expressions):
        self.model, self.expressions = model, expressions
        self.words, self.pairs, self.first = expressions.index()
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, int] = {}  # a word as it stands: its number, -1 without a letter or the like
        self.number: dict[bytes, int] = {}
        self.hash, self.size, self.odds, self.gain = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, 2)), np.empty(0)

    def learn(self, found: list[list[str]]) -> None:
        """Numbers for all words, and their probabilities."""
        if len(self.raw) > MEMORY:
            self.clear()
        new = []
        raw, number = self.raw, self.number
        for w in set().union(*found):
            if w in raw:
                continue
            plain = w.lower().encode().strip(_EDGE)
            if not plain:
                raw[w] = -1
                continue
            k = raw[w] = number.setdefault(plain, len(number))
            if k == len(self.size) + len(new):
                new.append(plain)
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            stream, at, sizes = stream_of(part)
            bits = np.add.reduceat(self.model.score(stream, at).astype(np.float64), np.cumsum(sizes) - sizes)
            h = word_hash(part)
            odds = self.expressions.of_words(self.words.lookup(h), np.exp2(-np.minimum(bits, 1000)))
            self.hash, self.size, self.odds = np.concatenate([self.hash, h]), np.concatenate([self.size, sizes]), np.concatenate([self.odds, odds])
            self.gain = np.concatenate([self.gain, told(odds)])

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [t.split() for t in texts]
        self.learn(found)
        seq = np.fromiter(map(self.raw.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        doc, seq = doc[seq >= 0], seq[seq >= 0]
        gain = self.gain
        at, word = np.divmod(np.unique(doc * (len(gain) + 1) + seq), len(gain) + 1)
        symbols = np.maximum(np.bincount(at, self.size[word], len(texts)), 1)
        mean = np.bincount(at, gain[word], len(texts)) / symbols
        at2, gain2 = self.known_pairs(doc, seq, gain)
        where, what = np.concatenate([at, at2]), np.concatenate([gain[word], gain2])
        order = np.lexsort((-what, where))
        where, what = where[order], what[order]
        nth = np.arange(len(where)) - np.searchsorted(where, where)
        top = np.zeros((len(texts), TOP))
        some = nth < TOP
        top[where[some], nth[some]] = what[some]
        return np.column_stack([mean, symbols, top])

    def known_pairs(self, doc: np.ndarray, seq: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' distinct pairs that are counted, and what each says a word: the first, then the second after it."""
        none = np.empty(0, np.int64), np.empty(0)
        if len(seq) < 2 or not len(self.expressions.pairs):
            return none
        row = self.pairs.lookup(pair_hash(self.hash[seq[:-1]], self.hash[seq[1:]]))
        here = np.flatnonzero((row >= 0) & (doc[1:] == doc[:-1]))
        here = here[np.unique(np.column_stack([doc[here], row[here]]), axis=0, return_index=True)[1]]
        if not len(here):
            return none
        odds = self.expressions.of_pairs(row[here], self.first.lookup(self.hash[seq[here]]), self.odds[seq[here + 1]])
        return doc[here], (gain[seq[here]] + told(odds)) / 2


def evidence(x: np.ndarray) -> np.ndarray:
    """Mean difference a symbol, the same weighed by the root of the symbols (noise shrinks with it), and the best expressions'
    bits (ENOUGH at most) less those that the best of so many would have by chance."""
    chance = np.log2(x[:, 1])[:, None]
    return np.column_stack([x[:, 0], x[:, 0] * np.sqrt(x[:, 1]) / 20, np.clip(x[:, 2:], 0, ENOUGH) - chance])


RIDGE = 0.1


def curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, deviations, coefficients. Evidence only ever speaks for toxic: a
    column that would get a negative coefficient, by the chance of few rows, is left out."""
    mu, sd = f.mean(0), f.std(0) + 1e-9
    used = np.arange(f.shape[1])
    while True:
        g, b = np.column_stack([((f - mu) / sd)[:, used], np.ones(len(f))]), np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(g @ b, -30, 30)))
            h = (g * (weight * p * (1 - p))[:, None]).T @ g + RIDGE * np.eye(len(b))
            b += np.linalg.solve(h, g.T @ (weight * (y - p)) - RIDGE * b)
        if not len(used) or b[:-1].min() >= 0:
            whole = np.zeros(f.shape[1] + 1)
            whole[used], whole[-1] = b[:-1], b[-1]
            return mu, sd, whole
        used = np.delete(used, b[:-1].argmin())


def probability(fitted, x: np.ndarray) -> np.ndarray:
    mu, sd, b = fitted
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(evidence(x) - mu) / sd, np.ones(len(x))]) @ b, -30, 30)))


def prior_score(x: np.ndarray) -> np.ndarray:
    """For too few labels for a curve: the bits of `SYMBOLS` symbols, and what the best expression has beyond chance,
    against a fixed prior."""
    bits = SYMBOLS * x[:, 0] + np.maximum(evidence(x)[:, 2] - DOUBT, 0)
    return 1 / (1 + np.exp(-np.clip(np.log(PRIOR / (1 - PRIOR)) + np.log(2) * bits, -30, 30)))


def shared_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Grams of SHARED bytes and in how many places of a document's distinct words, summed over all documents."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            stream, at, sizes = stream_of(list(seen))
            g, n = backoff._group(backoff.codes(stream, SHARED)[SHARED][at], np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), sizes))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], ["g", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(distinct_words(t))
                if len(seen) > MEMORY:
                    yield flushed()
        if seen:
            yield flushed()

    docs, text = positional(docs, text_col)
    words = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(grams, "g long, n long")
    rows = words.groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return rows.column("g").to_numpy().astype(np.uint64), rows.column("n").to_numpy()


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """id, y: of each class the n ids with the smallest hashes. A cut in the hash's range leaves some 2 n before any order is
    made, so no task sorts a class."""
    ids = frozen(ids.withColumn("h", F.xxhash64("id")), "labelled")
    out = None
    for y, total in ids.groupBy("y").count().collect():
        mine = ids.where(F.col("y") == y)
        if total > 4 * n:
            mine = mine.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * n // total)
        mine = mine.orderBy("h", "id").limit(n)
        out = mine if out is None else out.unionByName(mine)
    return ids if out is None else out


def parted(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts of each class and part, of what is counted at least twice in all."""
    of = lambda y, k: F.sum(F.when((F.col("part") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).cast("int").alias(f"y{y}p{k}")
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), *[of(y, k) for y in (1, 0) for k in range(FOLDS)]).where("n > 1").drop("n")


def by_part(rows: pa.Table) -> np.ndarray:
    """Counts as (row, class, part)."""
    return np.stack([np.column_stack([rows.column(f"y{y}p{k}").to_numpy() for k in range(FOLDS)]) for y in (1, 0)], 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int, held: int, n: int, most: int):
    """The models and their curve (None: `prior_score`), or no model and the share of toxic labels."""
    whole, ident, text = positional(docs, id_col, text_col)
    labels, marked, label = positional(labels, id_col, label_col)
    marks = labels.select(F.col(marked).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("y").alias("y")).where(remainder(F.col("id"), fold) != held)
    share = marks.agg(F.avg("y")).first()[0] or 0.0
    texts = whole.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") > 0)
    ids = first_by_hash(marks.where("y IN (0, 1)").join(texts.select("id"), "id", "left_semi"), n)
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(FOLDS)).cast("int")
    rows = texts.join(F.broadcast(ids.select("id", "y", "h", part.alias("part"))), "id")  # at most 2 n ids
    rows = frozen(rows.withColumn("text", F.substring("text", 1, most)), "toxic-sample")
    n_of = {r.y: r.n for r in rows.groupBy("y").agg(F.count_distinct("id").alias("n")).collect()}
    if not n_of.get(1) or not n_of.get(0):
        return None, share

    def groups(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
        found = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        for y, k in sorted({x[1:] for x in found}):
            yield y, k, [t for t, *at in found if at == [y, k]]

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, k, found in groups(b):
                if words := [w for t in found for w in all_words(t)]:
                    g, c = np.unique(grams_of(words, LONGEST), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(g), pa.int32()), pa.array([k] * len(g), pa.int32()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["y", "part", "g", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, k, found in groups(b):
                words, pairs = once(found)
                both = np.array(list(pairs), np.uint64).reshape(-1, 2)
                left, right = np.concatenate([np.zeros(len(words), np.uint64), both[:, 0]]), np.concatenate([word_hash(list(words)), both[:, 1]])
                n = np.fromiter([*words.values(), *pairs.values()], np.int64, len(left))
                same = lambda x, t: pa.array(np.full(len(left), x), t)
                yield pa.RecordBatch.from_arrays([same(y, pa.int32()), same(k, pa.int32()), pa.array(np.arange(len(left)) >= len(words)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(n)], ["y", "part", "pair", "a", "b", "n"])

    sample = rows.select("text", "y", "part")
    got = parted(sample.mapInArrow(count_bytes, "y int, part int, g long, n long"), ["g"]).toArrow()
    g, counts = got.column("g").to_numpy().view(np.uint64), by_part(got)
    del got  # the driver holds each table once
    if not counts.any((0, 2)).all():
        return None, share
    heard = parted(sample.mapInArrow(count_words, "y int, part int, pair boolean, a long, b long, n long"), ["pair", "a", "b"]).toArrow()
    pair, heard_n = heard.column("pair").to_numpy(zero_copy_only=False), by_part(heard)
    a, b = (heard.column(k).to_numpy().view(np.uint64) for k in ("a", "b"))
    del heard
    shared = shared_counts(docs, text_col)
    sc = docs.sparkSession.sparkContext

    def models(but: int | None):
        """Broadcast models of all parts but one."""
        grams, kept = (x.sum(2) - (0 if but is None else x[:, :, but]) for x in (counts, heard_n))
        some = grams.sum(1) > 1
        some_n = kept.sum(1) > 1  # counted without the part that is left out, as for a new document
        word, two = some_n & ~pair, some_n & pair
        expressions = Expressions(b[word], kept[word], a[two], b[two], kept[two])
        return sc.broadcast((make_model(g[some], grams[some], shared), expressions))

    sent = models(None)
    if min(n_of.values()) < FEW:
        return sent, None
    few = F.col("h") < F.when(F.col("y") == 1, F.lit(cut(rows, 1))).otherwise(F.lit(cut(rows, 0)))
    found = []
    for k in range(FOLDS):
        if not np.delete(counts, k, 2).any((0, 2)).all():
            continue  # all of a class is in this part
        model = models(k)

        def measure(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*model.value)
            for b in batches:
                x = scorer(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], ["y", *(f"x{j}" for j in range(x.shape[1]))])

        measured = rows.where(few & (F.col("part") == k)).select("text", "y").mapInArrow(measure, "y int, " + ", ".join(f"x{j} double" for j in range(2 + TOP))).toArrow()
        found.append(np.column_stack([c.to_numpy() for c in measured.columns]))
        model.unpersist()
    found = np.concatenate(found) if found else np.empty((0, 3 + TOP))
    found = found[np.lexsort(found.T)]
    y, x = found[:, 0], found[:, 1:]
    if not 0 < y.mean() < 1 if len(y) else True:
        return sent, None
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return sent, curve(evidence(x), y, weight)


def cut(rows: DataFrame, y: int, n: int = CURVE) -> int:
    """The hash below which n rows of the sample's class lie."""
    held = rows.where(F.col("y") == y).orderBy("h").select("h").limit(n + 1).agg(F.max("h"), F.count(F.lit(1))).first()
    return (1 << 63) - 1 if held[1] <= n else held[0]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 4, held: int = 2, n: int = SAMPLE, most: int = SAMPLE_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: identifier, held_out, score, predicted."""
    docs, ident, text = positional(docs, id_col, text_col)
    out = F.coalesce(remainder(F.col(ident), fold) == held, F.lit(True))
    rows = docs.select(F.col(ident).alias("id"), out.alias("held_out"), F.col(text).alias("text"))
    scored = with_score(rows, 2, ["id", "held_out"], fit(docs.select(F.col(ident).alias(id_col), F.col(text).alias(text_col)), labels, id_col, text_col, label_col, fold, held, n, most))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(rows: DataFrame, at: int, kept: list[str], fitted: tuple) -> DataFrame:
    """The kept first columns of rows and the score of the text in column `at`."""
    ship(rows.sparkSession)
    sent, fitted = fitted
    schema = rows.select(*kept, F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value) if sent else None
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [t or "" for t in part.column(at).to_pylist()]
                if scorer:
                    p = prior_score(scorer(texts)) if fitted is None else probability(fitted, scorer(texts))
                else:
                    p = np.full(len(texts), fitted)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(p, pa.float64())], names=[*kept, "score"])

    return rows.mapInArrow(score, schema)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 4, held: int = 2, n: int = SAMPLE, most: int = SAMPLE_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    rows, _, text = positional(docs, id_col, text_col)
    scored = with_score(rows, rows.columns.index(text), rows.columns, fit(docs, labels, id_col, text_col, label_col, fold, held, n, most))
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
