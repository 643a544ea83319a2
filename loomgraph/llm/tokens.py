"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens by the vocabulary's pattern. The pre-tokens of a
batch that the worker has not met before stand side by side in one ragged numpy
array of symbols. In every round each sequence finds its lowest-ranked pair and
merges all of that pair's places at once (in runs of overlapping places every
second one, from the left); sequences without a ranked pair leave. What is left
of a sequence is its tokens. A merge can only make pairs of higher rank than
its own, so a round does what the one-at-a-time rule would do.

Special strings inside a text are single tokens, as is the library's default.

Defined results: a null text is empty and has 0 tokens; repeated rows count
separately; an empty table gives an empty result; other columns are not read.
The memory of met pre-tokens is bounded (`MEMORY` entries a worker, those above
`LONGEST` bytes are never kept); texts above `SLICE` characters are matched in
slices of the match iterator, so a very long text needs no list of all of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, positional, ship
from .tables import HashIndex, ranges

LIMIT = 512
MEMORY, LONGEST, SLICE = 300_000, 64, 500_000
_LAST = np.int32(2**31 - 1)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class RankMerger:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.pairs = HashIndex((left << np.uint64(32)) | right)  # a pair's row is its rank
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.specials = special
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level pattern, a fixed value
        )
        self.met: dict[str, int] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Each word's symbols after all merges."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        left, done = np.arange(len(words)), [np.empty(0, np.int32)] * len(words)
        while len(left):
            ends = np.cumsum(size)
            rank = np.full(len(sym), _LAST, np.int32)
            if len(sym) > 1:
                found = self.pairs.lookup((sym[:-1].astype(np.uint64) << np.uint64(32)) | sym[1:].astype(np.uint64))
                rank[:-1] = np.where(found < 0, _LAST, found)
            some = size > 0
            rank[ends[some] - 1] = _LAST  # no pair reaches into the next word
            low = np.full(len(size), _LAST, np.int32)
            low[some] = np.minimum.reduceat(rank, (ends - size)[some]) if some.any() else low[some]
            over = low == _LAST
            if over.any():
                for k in np.flatnonzero(over):
                    done[left[k]] = sym[ends[k] - size[k] : ends[k]]
                stay = ranges((ends - size)[~over], size[~over])
                sym, rank, size, left, low = sym[stay], rank[stay], size[~over], left[~over], low[~over]
                if not len(left):
                    break
            row = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == low[row])
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = size - np.bincount(row[at], minlength=len(size))
            sym = sym[keep]
        return done

    def _counts(self, found: list[str]) -> int:
        """Tokens of pre-tokens that learn() has seen."""
        return sum(map(self.met.__getitem__, found))

    def learn(self, seen: set[str]) -> dict[str, int]:
        """Counts of all pre-tokens in seen; short ones stay in memory."""
        new = [w for w in seen if w not in self.met]
        if len(self.met) + len(new) > MEMORY:
            self.met.clear()
            new = list(seen)
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.met.update(zip(part, map(len, self.merge([w.encode() for w in part])), strict=True))
        return self.met

    def forget(self) -> None:
        for w in [w for w in self.met if len(w) > LONGEST]:
            del self.met[w]

    def count(self, texts: list[str]) -> list[int]:
        out, batch = [0] * len(texts), []
        for i, t in enumerate(texts):
            parts = [t]
            if self.special and any(s in t for s in self.specials):
                out[i] += len(self.special.findall(t))
                parts = self.special.split(t)
            for p in parts:
                if len(p) <= SLICE:
                    batch.append((i, self.pattern.findall(p)))
                    continue
                matches = self.pattern.finditer(p)
                while part := [m.group() for m in islice(matches, 100_000)]:
                    self.learn(set(part))
                    out[i] += self._counts(part)
                    self.forget()
        self.learn(set().union(*(words for _, words in batch)))
        for i, words in batch:
            out[i] += self._counts(words)
        self.forget()
        return out


@cache
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: identifier, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    docs, ident, text = positional(docs, id_col, text_col)
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = rows.select("id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(1).to_pylist()
                n = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(m.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
