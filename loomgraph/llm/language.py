"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to `ORDER`) with
escape probabilities (method C). The statistics are frozen after fitting, so the
code length of each byte under each language is a fixed function of it and the
bytes before it, and a text's code lengths are exact sums over the whole text.
The shortest code names the language; the score is its share of 2^-length.

Every language with a labelled row that has a letter is learned. What is bounded
is the tree of each: it is fitted on `SAMPLE` documents of the language (first in
the order of a hash of doc_id, among those whose text has a letter), and of a
longer document on its first `SAMPLE_BYTES` bytes. Languages are fitted and scored
`TOGETHER` at a time, each in columns of its own, so what is broadcast grows with
the number of languages and not with its square; each of these broadcasts has
`LARGEST` bytes at most: if there are more grams, the rarest of the longest go
first, then of the next. Held-out rows are never fitted on.

Defined results: a null text or one without a letter is `und` with score 0, as
is all text if there is no labelled row; ties go to the first language by name;
a null doc_id is held out, never fitted on; repeated rows are scored as they are;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import backoff
from .common import documents, frozen, positional, ship

ORDER = 4
SAMPLE, SAMPLE_BYTES, TOGETHER = 250, 32_768, 16
LARGEST = 128 << 20  # bytes of a model of TOGETHER languages
UNKNOWN = "und"
PAD = b"\n" * ORDER


def remainder(ident: Column, n: int) -> Column:
    return F.crc32(ident.cast("string")) % n


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each after padding; the positions of their bytes; their sizes."""
    stream = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    keep = np.ones(len(stream), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return stream, np.flatnonzero(keep), sizes


def fit(sample: list[tuple[str, str]], most: int = LARGEST) -> tuple[list[str], backoff.Backoff]:
    """Languages and their model from (language, text)."""
    names = sorted({lang for lang, _ in sample})
    counts: dict[int, list] = {m: [] for m in range(1, ORDER + 2)}
    for k, name in enumerate(names):
        stream, at, _ = stream_of([t.encode() for lang, t in sample if lang == name])
        code = backoff.codes(stream, ORDER + 1)
        for m in counts:
            g, n = np.unique(code[m][at], return_counts=True)
            column = np.zeros((len(g), len(names)), np.int64)
            column[:, k] = n
            counts[m].append((g, column))
    merged = {m: backoff._group(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts])) for m, parts in counts.items()}
    return names, backoff.ppm(bounded(merged, most))


def bounded(counts: dict[int, tuple[np.ndarray, np.ndarray]], most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The counts without as many of the rarest of the longest grams as a model of `most` bytes has no place for. Each gram
    takes 8 bytes and 8 for each class; its context and suffix may need rows besides."""
    row = 8 * (1 + next(iter(counts.values()))[1].shape[1])
    for m in sorted(counts, reverse=True):
        over = sum(len(g) for g, _ in counts.values()) - most // (2 * row)
        if over <= 0 or m == 1:
            break
        g, c = counts[m]
        total = c.sum(1)
        least = np.sort(total)[min(over, len(total)) - 1]  # all of one count stay or go together
        counts[m] = g[total > least], c[total > least]
    return counts


def code_lengths(model: backoff.Backoff, texts: list[str], chunk: int = 1 << 20) -> np.ndarray:
    """Bits of each whole text under each language. Long texts go through in chunks that overlap by a context."""
    out = np.zeros((len(texts), len(model.floor)))
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            stream, at, sizes = stream_of([t for _, t in group])
            bits = model.score(stream, at)
            some = sizes > 0
            sums = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64) if some.any() else bits[:0]
            np.add.at(out, np.array([i for i, _ in group])[some], sums)
        group, size = [], 0

    for i, t in enumerate(texts):
        data = t.encode()
        if len(data) > chunk:
            stream = np.frombuffer(PAD + data, np.uint8)
            for k in range(0, len(data), chunk):
                part = stream[k : k + ORDER + chunk]
                out[i] += model.score(part, np.arange(ORDER, len(part))).sum(0, dtype=np.float64)
            continue
        group.append((i, data))
        size += len(data)
        if size > chunk:
            flush()
    flush()
    return out


def sampled(docs: DataFrame, ident: Column, lang: Column, text: Column, n: int, most: int) -> DataFrame:
    """lang and the first bytes of the text of at most n rows a language, in the shared folder."""
    named = docs.select(ident.alias("id"), lang.alias("lang"), text.alias("text")).where(r"id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\p{L}'")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = named.select("id", "lang").withColumn("n", F.row_number().over(first)).where(f"n <= {n}").select("id", "lang").distinct()
    rows = named.join(F.broadcast(ids), ["id", "lang"])  # ids: at most n a language
    rows = rows.select("id", "lang", F.substring("text", 1, most).alias("text"))  # so many characters; the bytes are cut where they are read
    again = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text")  # repeated rows of an identifier
    return frozen(rows.withColumn("n", F.row_number().over(again)).where(f"n <= {n}").select("lang", "n", "text"), "language-sample")


def fit_all(sample: DataFrame, most: int, together: int = TOGETHER) -> list[tuple[list[str], backoff.Backoff]]:
    """The languages by name, so many together, each time with their model. The driver holds the texts of one group at a time."""
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())
    fitted = []
    for k in range(0, len(names), together):
        rows = sample.where(F.col("lang").isin(names[k : k + together])).orderBy("lang", "n").collect()
        fitted.append(fit([(r.lang, r.text.encode()[:most].decode(errors="ignore")) for r in rows]))
    return fitted


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, held: int = 0, n: int = SAMPLE, most: int = SAMPLE_BYTES) -> DataFrame:
    """One row per document: identifier, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    whole, ident, text, lang = positional(docs, id_col, text_col, lang_col)
    ident = F.col(ident)
    out = F.coalesce(remainder(ident, fold) == held, F.lit(True))
    learn = whole.where(~out)
    sample = sampled(learn, ident, F.col(lang).cast("string"), F.col(text), n, most)
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in fit_all(sample, most)]
    names = [name for x in shared for name in x.value[0]]
    rows = whole.select(ident.alias("id"), out.alias("held_out"), F.col(text).alias("text"))
    schema = rows.select("id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [t if t is not None and letter.search(t) else None for t in part.column(2).to_pylist()]
                known = [i for i, t in enumerate(texts) if t is not None and names]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    bits = np.hstack([code_lengths(x.value[1], [texts[i] for i in known]) for x in shared])
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                    for i, j, p in zip(known, best.tolist(), share.tolist(), strict=True):
                        langs[i], scores[i] = names[j], p
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
