"""Best-two-fit packing of documents into token sequences.

A document's ids end with a separator; only documents longer than a sequence
are cut, into full pieces after a first piece that takes the remainder. Full
pieces are sequences of their own. The others are dealt into groups of about
`per_group` pieces by a hash of their row, whatever their document or source,
and each group packs alone: a bin is filled greedily, always with the longest
piece that fits; if a gap is left, the bin's smallest piece is taken out and the
two unpacked pieces that fill the larger gap best replace it, when they fill it
better. A group's memory is bounded by per_group; ids never leave the worker
that made them, only (start, length, crc32) do. The number of groups follows
the number of pieces, and each costs a few sequences that are not full.

Defined results: a null or empty text is one piece with the separator alone;
repeated rows are packed separately; equal lengths are packed in any order; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frozen, positional, ship
from .tokens import byte_letters, vocabulary_path

SEQUENCE, SEPARATOR, PER_GROUP = 1024, 2, 20_000
#: Texts with a run of so many characters without (or of) white space go to the library whose merges are n log n.
RUN = 2000


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level pattern, a fixed value
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.slow = Tokenizer.from_file(path)
        self.white = regex.compile(r"\s{%d}" % RUN)

    def ids(self, text: str) -> list[int]:
        if len(text) > RUN and (max(map(len, text.split()), default=0) > RUN or self.white.search(text)):
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the remainder."""
    first = n % longest or longest
    return [(0, first), *((s, longest) for s in range(first, n, longest))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, longest: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """id, piece, start, length, ids_crc32: a row a piece."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    docs, ident, text = positional(docs, id_col, text_col)
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = rows.select("id", *[F.lit(0).cast(t).alias(c) for c, t in (("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))]).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*e.ids(text), separator], "<u4")
                for i, (s, n) in enumerate(cut(len(ids), longest)):
                    row.append(k)
                    piece.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(make, schema)


def two_fit(present: int, count: list[int], gap: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum up to gap; (0, 0) without any."""
    best, pair = 0, (0, 0)
    low = present & ((1 << gap) - 1)
    while low:
        a = low.bit_length() - 1
        if 2 * a <= best:
            break
        low ^= 1 << a
        most = min(a if count[a] > 1 else a - 1, gap - a)
        if under := present & ((1 << (most + 1)) - 1):
            b = under.bit_length() - 1
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
    return pair


def best_two_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of lengths (1 to size)."""
    count = np.bincount(lengths, minlength=size + 1).tolist()
    present = sum(1 << n for n in range(1, size + 1) if count[n])
    bins: list[list[int]] = []

    def take(n: int) -> None:
        nonlocal present
        count[n] -= 1
        if not count[n]:
            present ^= 1 << n

    while present:
        gap, held = size, []
        while fits := present & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            take(n)
            held.append(n)
            gap -= n
            if not gap:
                break
        if gap and len(held) > 1:
            small = held[-1]
            a, b = two_fit(present, count, gap + small)
            if a + b > small:
                held[-1:] = [a, b]
                take(a)
                take(b)
                count[small] += 1
                present |= 1 << small
        bins.append(held)
    order = np.argsort(lengths, kind="stable")
    at = np.searchsorted(lengths[order], np.arange(size + 2)).tolist()
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, held in enumerate(bins):
        place = 0
        for n in held:
            i = order[at[n]]
            at[n] += 1
            bin_of[i], offset[i] = k, place
            place += n
    return bin_of, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE, separator: int = SEPARATOR, per_group: int = PER_GROUP) -> DataFrame:
    """One row per piece with its sequence and place in it."""
    made = pieces(docs, id_col, text_col, path, size, separator).withColumn("rid", F.monotonically_increasing_id())
    made = frozen(made, "pieces")
    whole = made.where(F.col("length") == size).withColumns({"sequence_id": -F.col("rid") - 1, "offset": F.lit(0).cast("long")})
    rest = made.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // per_group))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    schema = whole.schema

    def group(table: pa.Table) -> pa.Table:
        bin_of, offset = best_two_fit(table.column("length").to_numpy(), size)
        first = table.column("group")[0].as_py() << 40
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(bin_of + first)).append_column("offset", pa.array(offset))

    packed = rest.groupBy("group").applyInArrow(group, schema)
    return whole.unionByName(packed).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
