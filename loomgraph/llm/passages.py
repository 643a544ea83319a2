"""Exact removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a `SPAN`-byte string that covers it also starts in a document
with a smaller identifier. The strings are found without sorting every suffix:

* Suffixes are taken at content-chosen anchors only (a sparse suffix array): a
  window of SPAN bytes is filed under the smallest hash of its `GRAM`-byte
  substrings, so equal windows have the same anchor wherever they stand. Runs of
  neighbouring windows with the same anchor make one segment.
* Documents are packed into batches, and each batch gets its suffix array: its
  segments in the order of anchor and segment fingerprints (128 bits between
  them), dealt into buckets by the anchor, with the smallest identifier for each.
* In a bucket the batches' arrays come one by one to a family of levels. Each is
  first merge-scanned against the levels that exist: for every entry, the smallest
  identifier so far that has it, and what else its anchor has met. Then it becomes
  a level itself, and two levels of one size class merge, so a bucket of n entries
  costs n log n however many batches come. As matches go both ways, the arrays
  come a second time in reverse order to a new family: what an array met on both
  ways is all that the bucket has.
* A segment whose whole content occurs in a document with a smaller identifier
  is repeated in full. If its anchor occurs with other content, its text (at
  most SPAN + 30 bytes) comes to the bucket once, and its windows are compared
  one by one, hits byte by byte. All other segments are unique.

Fingerprint order takes the place of byte order: the scans only ask for equality
of whole prefixes, which any fixed order answers, and numpy sorts 64-bit numbers
some thirty times faster than byte strings.

A passage that a third of the documents share is one entry a batch. Buckets are
bounded by `BUCKET` entries on average, and grow in number with the input, up to
`MAX_BUCKETS`, and batches with them; beyond some 400 GB of text buckets grow
too (24 bytes an entry, an entry for some 16 bytes of text). An anchor with very
many different contexts is compared in classes of its windows, so memory beyond
the contexts themselves (80 bytes each) is bounded. Texts
are stored once, compressed, in a bucketed table in the shared folder, so they are
joined with what the buckets found without moving again.

Defined results: matches never cross documents; a null text is empty; a text
shorter than SPAN loses nothing; a null identifier counts as 2^63 - 1, the
largest; of rows with the same identifier none is smaller, so they don't take
bytes from each other; an empty table gives an empty result; other columns are
not read. Identifiers are integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frozen, frozen_by, positional, ship
from .tables import ranges

SPAN, GRAM = 50, 20
WIDE = SPAN - GRAM + 1  # windows that one anchor can serve
BATCH, CHUNK, BUCKET = 3 << 20, 1 << 19, 400_000
MAX_BUCKETS, LARGEST_BATCH = 1 << 16, 48 << 20
FEW_BUCKETS = 4096  # more only with larger batches: a batch should have some dozen entries a bucket
_LAST = np.iinfo(np.int64).max
_C = (np.random.default_rng(50).integers(1, 2**63, 24, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(stream: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; stream has 64 spare bytes at its end."""
    return np.ndarray(len(stream) - 8, "<u8", buffer=stream, strides=(1,)).copy()


def fingerprint(w: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of the SPAN = 50 bytes from each position on. Another seed (12) gives an independent one."""
    h = w[at] * _C[seed]
    for k, o in enumerate((8, 16, 24, 32, 40, 42), 1):
        h = _mix(h) + w[at + o] * _C[seed + k]
    return _mix(h)


class Segments:
    """Runs of windows with one anchor, over documents that stand in one array.

    start, count: first window and number of windows; doc: which document; anchor; content, check: two hashes of the run's bytes.
    """

    def __init__(self, texts: list[bytes]):
        self.stream = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        parts, lo = [], 0
        ends = np.cumsum(self.size)
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, self.begin[lo] + CHUNK, "right")))
            if hi == lo + 1:  # a long document goes window by window too
                for first in range(0, max(1, int(self.size[lo])), CHUNK):
                    parts.append(self._chunk(lo, self.begin[lo] + first, np.minimum(self.size[lo : lo + 1] - first, CHUNK + SPAN - 1)))
            else:
                parts.append(self._chunk(lo, self.begin[lo], self.size[lo:hi]))
            lo = hi
        self.start, self.count, self.doc, self.anchor, self.content, self.check = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (*(np.empty(0, np.int64),) * 3, *(np.empty(0, np.uint64),) * 3)

    def _chunk(self, lo: int, base: int, n: np.ndarray):
        """The segments of documents lo, lo + 1, ... of n bytes each from base on."""
        begin, total = np.cumsum(n) - n, int(n.sum())
        w = words_of(self.stream[base : base + total + 64])
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
        if total < SPAN:
            return none
        m = w[: total - GRAM + 1] * _C[7]
        m += w[8 : 8 + len(m)] * _C[8]
        m += w[GRAM - 8 : GRAM - 8 + len(m)] * _C[9]
        m = _mix(m)
        reach = 1
        while 2 * reach <= WIDE:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        m = np.minimum(m[: total - SPAN + 1], m[WIDE - reach : WIDE - reach + total - SPAN + 1])
        new = np.empty(len(m) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(m[1:], m[:-1], out=new[1:-1])
        new[begin[begin < len(m)]] = True
        last = begin + np.maximum(n - SPAN + 1, 0)  # the first place without a whole window
        new[last[last < len(m)]] = True
        cut = np.flatnonzero(new)
        start, count = cut[:-1], np.diff(cut)
        doc = np.searchsorted(begin, start, "right") - 1
        inside = start < last[doc]
        start, count, doc = start[inside], count[inside], doc[inside]
        if (count > WIDE).any():  # text that repeats itself
            pieces = -(-count // WIDE)
            step = ranges(np.zeros(len(count), np.int64), pieces)
            start, doc = np.repeat(start, pieces) + WIDE * step, np.repeat(doc, pieces)
            count = np.minimum(np.repeat(count, pieces) - WIDE * step, WIDE)
        content, check = (_mix(_mix(fingerprint(w, start, k) + count.astype(np.uint64)) + fingerprint(w, start + count - 1, k) * _C[k + 10]) for k in (0, 12))
        return start + base, count, doc + lo, _mix(m[start] * _C[11]), content, check


class Array:
    """A batch's suffix array: its segments' entries by bucket and key, with the smallest identifier of each."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], bits: int):
        self.segments = s = Segments(texts)
        self.of = ids[s.doc]
        bucket = (s.anchor >> np.uint64(64 - bits)).astype(np.int64)
        key = ((s.anchor << np.uint64(bits)) & ~np.uint64((1 << 38) - 1)) | (s.content >> np.uint64(26))
        order = np.lexsort((self.of, s.check, key, bucket))
        b, k, c = bucket[order], key[order], s.check[order]
        first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(order) else order
        self.bucket, self.key, self.check, self.least = b[first], k[first], c[first], self.of[order][first]
        self.sample = order[first]  # a segment of the document with the smallest identifier
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.repeat(np.arange(len(first)), np.diff([*first, len(order)]))
        self.cuts = np.concatenate([[0], np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1, [len(first)]]).astype(np.int64) if len(first) else np.zeros(1, np.int64)

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        for lo, hi in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield int(self.bucket[lo]), slice(lo, hi)


class Level:
    """Entries (key, check, least identifier) in order, and for each anchor among them how many there are and the
    smallest and largest of their identifiers."""

    def __init__(self, key: np.ndarray, check: np.ndarray, least: np.ndarray):
        self.key, self.check, self.least = key, check, least
        a = anchor_of(key)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        self.anchor, self.count = a[first], np.diff([*first, len(a)])
        self.low, self.high = (np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)) if len(a) else (least, least)

    def __len__(self) -> int:
        return len(self.key)

    def merged(self, other: Level) -> Level:
        key, check, least = (np.concatenate(x) for x in ((self.key, other.key), (self.check, other.check), (self.least, other.least)))
        order = np.argsort(key, kind="stable")  # two sorted runs: a merge
        key, check, least = key[order], check[order], least[order]
        if (tied := key[1:] == key[:-1]).any() and (check[1:][tied] < check[:-1][tied]).any():  # equal keys of different content
            order = np.lexsort((check, key))
            key, check, least = key[order], check[order], least[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
        return Level(key[first], check[first], np.minimum.reduceat(least, first))

    def rows(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where these entries stand; -1 for those that are not here."""
        at, row = np.searchsorted(self.key, key), np.full(len(key), -1)
        todo = np.flatnonzero(at < len(self))
        while len(todo := todo[self.key[at[todo]] == key[todo]]):
            hit = self.check[at[todo]] == check[todo]
            row[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < len(self)]
        return row


class Seen:
    """What an array's entries have met: the least identifier that has the same content, the anchor's other contents, and the
    smallest and largest identifier at the anchor."""

    def __init__(self, own: Level):
        self.own, self.place = own, np.repeat(np.arange(len(own.anchor)), own.count)
        self.least, self.others = own.least.copy(), own.count[self.place] - 1
        self.low, self.high = own.low[self.place].copy(), own.high[self.place].copy()

    def scan(self, level: Level) -> None:
        row = level.rows(self.own.key, self.own.check)
        same = row >= 0
        self.least[same] = np.minimum(self.least[same], level.least[row[same]])
        at = np.searchsorted(level.anchor, self.own.anchor)
        here = at < len(level.anchor)
        here[here] = level.anchor[at[here]] == self.own.anchor[here]
        some = here[self.place]
        there = at[self.place[some]]
        self.others[some] += level.count[there] - same[some]
        self.low[some] = np.minimum(self.low[some], level.low[there])
        self.high[some] = np.maximum(self.high[some], level.high[there])

    def status(self) -> np.ndarray:
        """0 unique, 1 repeated in full, 2 to be compared window by window."""
        return np.where(self.least < self.own.least, 1, np.where((self.others > 0) & (self.low < self.high), 2, 0)).astype(np.uint8)


class Family:
    """The logarithmic family of a bucket: levels, each over twice the next one's size."""

    def __init__(self):
        self.levels: list[Level] = []

    def take(self, array: Seen) -> None:
        """The array is scanned against every level that is here, then becomes one."""
        for level in self.levels:
            array.scan(level)
        self.levels.append(array.own)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            self.levels.append(self.levels.pop().merged(self.levels.pop()))


def anchor_of(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(38)


def scan(arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The status of each array's entries (key, check, least) after all arrays have come, and come again in reverse order."""
    seen = [Seen(Level(*x)) for x in arrays]
    for way in (seen, seen[::-1]):
        family = Family()
        for array in way:
            family.take(array)
    return [x.status() for x in seen]


def compare(anchor: np.ndarray, least: np.ndarray, count: np.ndarray, text: np.ndarray, part: int = 16_384) -> np.ndarray:
    """For each segment a mask of its windows that occur in a document with a smaller identifier.
    Goes through the anchors some at a time, so memory follows part and not the bucket."""
    out = np.zeros(len(anchor), np.uint32)
    order = np.argsort(anchor, kind="stable")
    ends = np.flatnonzero(np.concatenate([anchor[order][1:] != anchor[order][:-1], [True]])) + 1 if len(order) else order
    lo = 0
    while lo < len(order):
        hi = int(ends[min(np.searchsorted(ends, lo + part), len(ends) - 1)])
        at = order[lo:hi]
        classes = -(-(hi - lo) // (2 * part))  # over one only for an anchor with more segments than part
        for k in range(classes):
            out[at] |= _compare(anchor[at], least[at], count[at], text[at], k, classes, part)
        lo = hi
    return out


def _compare(anchor: np.ndarray, least: np.ndarray, count: np.ndarray, text: np.ndarray, k: int = 0, classes: int = 1, part: int = 16_384) -> np.ndarray:
    """The windows whose fingerprint falls into class k."""
    out, width, parts = np.zeros(len(anchor), np.uint32), text.shape[1], []
    for lo in range(0, len(anchor), part):
        n = count[lo : lo + part]
        w = words_of(np.concatenate([text[lo : lo + part].ravel(), np.zeros(64, np.uint8)]))
        step, row = ranges(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
        f = fingerprint(w, row * width + step)
        mine = f % np.uint64(classes) == k if classes > 1 else slice(None)
        parts.append((row[mine] + lo, step[mine], f[mine]))
    row, step, found = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(row):
        return out
    order = np.argsort(_mix(anchor[row] * _C[3] ^ found))
    row, step, found = row[order], step[order], found[order]
    a, d = anchor[row], least[row]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (found[1:] != found[:-1])]))
    sizes = np.diff([*first, len(row)])
    group = np.repeat(np.arange(len(first)), sizes)
    low = np.minimum.reduceat(d, first)
    hit = d > low[group]
    # The bytes decide: every window of a group with a hit is held against the group's first.
    suspects = np.flatnonzero((np.bincount(group[hit], minlength=len(first)) > 0)[group])
    wrong = np.zeros(len(first), bool)
    for lo in range(0, len(suspects), 50_000):
        at = suspects[lo : lo + 50_000]
        one, other = (text[row[x][:, None], step[x][:, None] + np.arange(SPAN)] for x in (at, first[group[at]]))
        wrong[group[at[(one != other).any(1)]]] = True
    for g in np.flatnonzero(wrong).tolist():  # different bytes under one fingerprint
        at = range(first[g], first[g] + sizes[g])
        whole = [text[row[x], step[x] : step[x] + SPAN].tobytes() for x in at]
        least_of = {}
        for x, t in zip(at, whole, strict=True):
            least_of[t] = min(least_of.get(t, _LAST), d[x])
        hit[first[g] : first[g] + sizes[g]] = [d[x] > least_of[t] for x, t in zip(at, whole, strict=True)]
    np.bitwise_or.at(out, row[hit], np.uint32(1) << step[hit].astype(np.uint32))
    return out


def removed(array: Array, status: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the batch's stream go. masks: of the entries with status 2, in order."""
    s = array.segments
    mask = np.zeros(len(array.key), np.uint32)
    mask[status == 2] = masks
    later = array.of > array.least[array.entry]
    full = later | (status[array.entry] == 1)
    total = len(s.stream) - 64
    repeated = np.zeros(total, bool)
    repeated[ranges(s.start[full], s.count[full])] = True
    some = np.flatnonzero(~full & (mask[array.entry] != 0))
    if len(some):
        step = ranges(np.zeros(len(some), np.int64), s.count[some])
        row = np.repeat(some, s.count[some])
        hit = (mask[array.entry[row]] >> step.astype(np.uint32)) & np.uint32(1) == 1
        repeated[(s.start[row] + step)[hit]] = True
    upto = np.cumsum(repeated, dtype=np.int32)
    gone = upto > 0
    gone[SPAN:] = upto[SPAN:] > upto[:-SPAN]
    return gone


def _pack(ids: list[int | None], texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    import zstandard

    known = np.array([_LAST if i is None else i for i in ids], "<i8")
    sizes = np.array([len(t) if i is not None else -len(t) - 1 for i, t in zip(ids, texts, strict=True)], "<i8")  # below 0: of a null identifier
    return known.tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _unpack(ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Identifiers, texts, and which identifiers are null."""
    import zstandard

    n = np.frombuffer(sizes, "<i8")
    null = n < 0
    n = np.where(null, -n - 1, n)
    whole = memoryview(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(n.sum()))))
    ends = np.cumsum(n).tolist()
    return np.frombuffer(ids, "<i8"), [bytes(whole[e - k : e]) for e, k in zip(ends, n.tolist(), strict=True)], null


def batches_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, int]:
    """The documents in batches of about size bytes, as a table bucketed by batch; and the bytes of text."""
    docs, ident, text = positional(docs, id_col, text_col)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            row = [uuid.uuid4().int >> 65, *_pack(ids, texts), held]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:4]), pa.array([row[4]], pa.int64())], ["batch", "ids", "sizes", "data", "n_bytes"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t.encode())
                held += len(texts[-1])
                if held >= size:
                    yield done()
                    ids, texts, held = [], [], 0
        if ids:
            yield done()

    made = rows.mapInArrow(make, "batch long, ids binary, sizes binary, data binary, n_bytes long")
    table = frozen_by(made, "batches", "batch", {"compression": "uncompressed", "parquet.block.size": 16 << 20})
    return table, table.agg(F.sum("n_bytes")).first()[0] or 0


def _about(docs: DataFrame) -> int:
    """Bytes of docs as the optimizer has them: it only sets the size of batches, results do not depend on it."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row at a time: rows hold megabytes, so a batch is not turned into Python objects at once."""
    for b in batches:
        for k in range(b.num_rows):
            yield [c[k].as_py() for c in b.columns]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Rows of sorted batches with the same first column, as lists of columns."""
    key, rows = None, []
    for b in batches:
        for row in _rows([b]):
            if row[0] != key and rows:
                yield [list(c) for c in zip(*rows, strict=True)]
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield [list(c) for c in zip(*rows, strict=True)]


def _by_batch(found: DataFrame) -> DataFrame:
    return found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))


def _status(array: Array, found: list | None, dtype) -> list[np.ndarray]:
    """What each bucket found, in the order of the array's buckets."""
    by = {x["bucket"]: x["found"] for x in found or []}
    return [np.frombuffer(by.get(b, b""), dtype) for b, _ in array.by_bucket()]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, bucket: int = BUCKET, with_text: bool = False) -> DataFrame:
    """One row per document: identifier, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes)."""
    ship(docs.sparkSession)
    kind = positional(docs, id_col)[0].schema[positional(docs, id_col)[1]].dataType
    batch = max(batch, min(LARGEST_BATCH, batch * (_about(docs) // (16 * bucket * FEW_BUCKETS))))
    table, total = batches_of(docs, id_col, text_col, batch)
    bits = min(max(2, (total // 16 // bucket).bit_length()), MAX_BUCKETS.bit_length() - 1)

    def arrays(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, sizes, data in _rows(rows):
            a = Array(*_unpack(ids, sizes, data)[:2], bits)
            out = [(k, a.key[s].tobytes(), a.check[s].tobytes(), a.least[s].astype("<i8").tobytes()) for k, s in a.by_bucket()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([name] * len(out), pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["bucket", "batch", "key", "check", "least"])

    def scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, names, keys, checks, leasts in _groups(rows):
            found = scan([(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), np.frombuffer(z, "<i8")) for x, y, z in zip(keys, checks, leasts, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["bucket", "batch", "found"])

    def dealt(found: DataFrame) -> DataFrame:
        return found.repartition("bucket").sortWithinPartitions("bucket", "batch")

    text = table.select("batch", "ids", "sizes", "data")
    sent = dealt(text.mapInArrow(arrays, "bucket long, batch long, key binary, check binary, least binary"))
    status = frozen(_by_batch(sent.mapInArrow(scanned, "bucket long, batch long, found binary")), "status")

    def contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, sizes, data, found in _rows(rows):
            a = Array(*_unpack(ids, sizes, data)[:2], bits)
            s, out = a.segments, []
            for (k, part), st in zip(a.by_bucket(), _status(a, found, np.uint8), strict=True):
                at = np.flatnonzero(st == 2)
                if len(at):
                    seg = a.sample[part][at]
                    pos = s.start[seg][:, None] + np.arange(SPAN + WIDE - 1)
                    whole = s.stream[np.minimum(pos, len(s.stream) - 1)]
                    whole[np.arange(SPAN + WIDE - 1) >= (s.count[seg] + SPAN - 1)[:, None]] = 0
                    out.append((k, anchor_of(a.key[part][at]).astype("<u4").tobytes(), a.least[part][at].astype("<i8").tobytes(), s.count[seg].astype(np.uint8).tobytes(), whole.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([name] * len(out), pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], ["bucket", "batch", "anchor", "least", "count", "text"])

    def compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, names, anchors, leasts, counts, texts in _groups(rows):
            join = lambda parts, t: np.frombuffer(b"".join(parts), t)
            masks = compare(join(anchors, "<u4").astype(np.uint64), join(leasts, "<i8"), join(counts, np.uint8).astype(np.int64), join(texts, np.uint8).reshape(-1, SPAN + WIDE - 1))
            ends = np.cumsum([len(c) for c in counts]).tolist()
            found = [masks[e - len(c) : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(names, pa.int64()), pa.array(found, pa.binary())], ["bucket", "batch", "found"])

    both = text.join(status.hint("shuffle_hash"), "batch", "left")
    sent = dealt(both.mapInArrow(contexts, "bucket long, batch long, anchor binary, least binary, count binary, text binary"))
    masks = frozen(_by_batch(sent.mapInArrow(compared, "bucket long, batch long, found binary")), "masks")

    def results(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sizes, data, found, mask in _rows(rows):
            ids, texts, null = _unpack(ids, sizes, data)
            a = Array(ids, texts, bits)
            st = np.concatenate([np.empty(0, np.uint8), *_status(a, found, np.uint8)])
            gone = removed(a, st, np.concatenate([np.empty(0, np.uint32), *_status(a, mask, np.uint32)]))
            out = []
            for i, none, t, lo in zip(ids.tolist(), null.tolist(), texts, a.segments.begin.tolist(), strict=True):
                g = gone[lo : lo + len(t)]
                n = int(g.sum())
                kept = np.frombuffer(t, np.uint8)[~g].tobytes() if n else t
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
                out.append((None if none else i, len(t), n, spans, sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string(), pa.binary()], strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    last = text.join(status.hint("shuffle_hash"), "batch", "left").join(masks.withColumnRenamed("found", "masks").hint("shuffle_hash"), "batch", "left")
    done = last.mapInArrow(results, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return done.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_text else []))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
