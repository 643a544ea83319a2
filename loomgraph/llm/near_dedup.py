"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Equal sets
collapse first, by the tree merge of digest runs, to one representative. Each
representative gets `COORDINATES` minwise values. In each of `TREES` independent
trees a root branches by the token that is minimal under the tree's own hash
function; a node of more than `LIMIT` members branches again, along `BRANCHES`
other functions at once, up to `DEPTH` times. Two sets of similarity 0.75 meet
in a tree with probability 0.75 (0.70, 0.66 and 0.62 where nodes branch once, twice
or three times), so all trees miss one in 10^7 (10^6, 10^5).

Only links that can join two components are confirmed. First every member of a
root node is held against the node's smallest member; in large nodes what is
left then meets members of the node's largest component. Nodes whose members are
one component are done; only nodes with several, and with more than LIMIT
members outside the largest, branch. Then the nodes' members are compared with
one another across components, exhaustively, by sketch (256 bytes; a pair of
similarity 0.75 falls under the cutoff by chance once in some 10^6): first for
the best candidate of each component, then for all members that have a candidate
left. These meet in their nodes once more with their sets, which are compared
exactly, and what joins components goes on. Nodes above LIMIT are compared in
blocks, none dropped. Every link is confirmed on the full sets, made again from
the whole texts. Components come from alternating large-star and small-star steps.

A document that many are held against meets them in blocks of about BLOCK, and
its row travels once a block. Sets that are compared exactly come together by
SHINGLES shingles at most, or as one pair of longer ones. Repeated rows have one
text between them.

No step emits a node's pairs: each emits a row a member or component. Copies are
members of a class and never expanded.

Defined results: a text with fewer words than five is one shingle; a null text
or one without words has an empty set, links with nothing and is its own
component; a null identifier takes part, and is a component's name only if no
member has an identifier; repeated rows are members of one class; an empty table
gives an empty result; other columns are not read by `near_duplicates` and pass
through `keep_one` untouched, whatever their names. Of rows with the same
identifier and text `keep_one` keeps any one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, frozen, frozen_by, positional, row_key, ship
from .exact_dedup import climb, descend

WORDS, PERCENT = 5, 75
COORDINATES, TREES, LIMIT, BRANCHES, DEPTH = 256, 12, 4096, 2, 3
CUTOFF = 0.62
COARSE, COARSE_CUTOFF = 64, 0.48  # the first coordinates alone, to find members without any candidate
PASSES = 2  # against one member each, before large nodes branch
MEMORY = 400_000
BLOCK, SHINGLES = 1000, 1 << 23
SEED = 20_240_607

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_M = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of whole texts."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash, self.met = words, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.met) > MEMORY:
            self.met.clear()
        met, new = self.met, self.hash
        h = np.empty(len(words), np.uint64)
        for k, w in enumerate(words) if len(words) < 4 else ():
            h[k] = new(w)
        if len(words) >= 4:
            for w in set(words):
                if w not in met:
                    met[w] = new(w)
            h = np.fromiter(map(met.__getitem__, words), np.uint64, len(words))
        if len(h) < self.words:
            return _mix(np.array([sum(int(x) * int(m) for x, m in zip(h, _M, strict=False)) + len(h) & (1 << 64) - 1], np.uint64))
        n = len(h) - self.words + 1
        s = h[:n] * _M[0]
        for k in range(1, self.words):
            s = _mix(s) + h[k : n + k] * _M[k]
        return np.unique(_mix(s))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set (none empty): its minimum under each hash function."""
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i, s in enumerate(sets):
        low = None
        for k in range(0, len(s), 2048):
            v = (s[None, k : k + 2048] * _A[:, None] + _B[:, None]).min(1)
            low = v if low is None else np.minimum(low, v)
        out[i] = low
    return out


def key_of(ident: Column, text: Column) -> Column:
    return row_key(ident, F.hex(F.xxhash64(text)), F.octet_length(text))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, key, n, set (digest), roots (a token a tree), sketch: a row a document."""
    docs, ident, text = positional(docs, id_col, text_col)
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("id", key_of(F.col("id"), F.col("text")).alias("key"), "text")
    schema = rows.select("id", "key", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("set"), F.array(F.lit(0).cast("long")).alias("roots"), F.lit(b"").alias("sketch")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [shingle(t) for t in part.column(2).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                low = np.zeros((len(sets), COORDINATES), np.uint64)
                if some:
                    low[some] = minwise([sets[i] for i in some])
                low = _mix(low)
                roots = pa.ListArray.from_arrays(pa.array(np.arange(0, TREES * len(sets) + 1, TREES), pa.int32()), pa.array(low[:, :TREES].ravel().view(np.int64)))
                sketch = low.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), roots, pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["id", "key", "n", "set", "roots", "sketch"],
                )

    return rows.mapInArrow(make, schema).withColumn("rid", F.monotonically_increasing_id())


def roots(reps: DataFrame) -> DataFrame:
    """node, rid, tree: the first nodes of all trees, of at least two members."""
    root = reps.select("rid", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "rid", "tree")
    return several(root)


def several(level: DataFrame) -> DataFrame:
    # the nodes are frozen, so that a large node's members are not tied to the task that counted them
    return level.join(frozen(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "nodes"), "node")


def apart(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """nodes of several components: node, rid, tree, comp, size, major (the largest component) and minor (members outside it)."""
    held = nodes.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    by = held.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"))
    by = by.select("node", "size", F.col("top.comp").alias("major"), (F.col("size") - F.col("top.c")).alias("minor")).where("minor > 0")
    return held.join(frozen(by, "apart"), "node")


def branched(held: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """node, rid, tree: the nodes of several components in which the trees end. held: apart() of the roots."""
    found = None
    for depth in range(DEPTH + 1):
        big = (F.col("minor") > LIMIT) & F.lit(depth < DEPTH)
        ends = held.where(~big).select("node", "rid", "tree")
        found = ends if found is None else found.unionByName(ends)
        grow = held.where(big)
        if grow.isEmpty():
            break
        grow = grow.join(reps.select("rid", "sketch"), "rid").withColumn("branch", F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)])))
        at = TREES + F.pmod(F.col("tree") * 13 + F.lit(depth * 7 * BRANCHES) + F.col("branch") * 7, F.lit(COORDINATES - TREES))
        token = F.substring(F.hex("sketch"), 2 * at + 1, F.lit(2))
        level = several(frozen(grow.select(F.xxhash64("node", "branch", token).alias("node"), "rid", "tree"), "branches"))
        held = frozen(apart(level, comps), f"level-{depth}")
    return found


def _bytes(column: pa.Array) -> np.ndarray:
    """The sketches of a column, all of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the rows of two sketch tables agree: lanes of 8 bytes are added up, then their bytes."""
    lanes = np.ascontiguousarray(a == b).view(np.uint64).sum(1, dtype=np.uint64)  # a lane counts to 32 at most
    return ((lanes & np.uint64(0x00FF00FF00FF00FF)) + ((lanes >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))) * np.uint64(0x0001000100010001) >> np.uint64(48)


def gathered(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """a, block, b and columns of table: for each block of a's partners a's own row (b = -1), then theirs, in one task."""
    pairs = frozen(pairs.select("a", "b"), "pairs")
    hubs = frozen(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("a", F.ceil(F.col("n") / BLOCK).alias("blocks")), "hubs")
    dealt = pairs.join(hubs, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)).alias("block"), "b")
    own = dealt.select("a", "block").distinct().join(table.select(F.col("rid").alias("a"), *columns), "a")
    rest = dealt.join(table.select(F.col("rid").alias("b"), *columns), "b")
    both = own.select("a", "block", F.lit(-1).cast("long").alias("b"), *columns).unionByName(rest.select("a", "block", "b", *columns))
    return both.repartition("a", "block").sortWithinPartitions("a", "block", "b")


def against_one(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and sketches allow the link; a is what many are held against."""
    rows = gathered(pairs.select("a", "b").where("a <> b").distinct(), reps, ["n", "sketch"])

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sketch = np.zeros(1, np.int64), np.zeros((1, COORDINATES), np.uint8)  # of the last a
        for rows in batches:
            if rows.num_rows:
                b, n, own = rows.column(2).to_numpy(), rows.column(3).to_numpy(), _bytes(rows.column(4))
                first = np.flatnonzero(b < 0)
                size, sketch = np.concatenate([size, n[first]]), np.concatenate([sketch, own[first]])
                at = np.searchsorted(first, np.arange(len(b)), "right")
                near = np.minimum(n, size[at]) * 100 >= np.maximum(n, size[at]) * PERCENT
                yield rows.select([0, 2]).filter(pa.array((b >= 0) & near & (agreement(own, sketch[at]) >= CUTOFF * COORDINATES)))
                size, sketch = size[-1:], sketch[-1:]

    return rows.mapInArrow(allow, "a long, b long")


def doubtful(rid, comp, n, sketch, cross) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of members of different components whose sketches allow a link, and in how many coordinates they
    differ. cross: blocks, compared across only."""
    none = np.empty(0, np.int64)
    parts = [(none, none, none)]
    width = sketch.shape[1]
    least = (CUTOFF if width == COORDINATES else COARSE_CUTOFF) * width
    step = max(1, 262_144 // len(rid))
    for lo in range(0, len(rid), step):
        hi = min(lo + step, len(rid))
        ok = (comp[lo:hi, None] != comp[None, lo:]) & (np.arange(lo, hi)[:, None] < np.arange(lo, len(rid))[None, :])
        ok &= np.minimum(n[lo:hi, None], n[None, lo:]) * 100 >= np.maximum(n[lo:hi, None], n[None, lo:]) * PERCENT
        if cross is not None:
            ok &= cross[lo:hi, None] != cross[None, lo:]
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000] + lo, j[k : k + 20_000] + lo
            alike = agreement(sketch[x], sketch[y])
            good = alike >= least
            parts.append((x[good], y[good], width - alike[good].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def best_links(rid, comp, n, sketch, cross) -> list[tuple[int, int]]:
    """The best candidate of each component of a node."""
    i, j, miss = doubtful(rid, comp, n, sketch, cross)
    order = np.lexsort((j, i, miss))
    one = [np.unique(comp[x][order], return_index=True)[1] for x in (i, j)]
    pick = order[np.unique(np.concatenate(one))] if len(i) else order
    return list(zip(np.minimum(rid[i[pick]], rid[j[pick]]).tolist(), np.maximum(rid[i[pick]], rid[j[pick]]).tolist(), strict=True))


def exact_links(rid, comp, sets: list[np.ndarray], tile: int = 1024) -> list[tuple[int, int]]:
    """Pairs of members of different components with enough in common, as many as join them (a forest). Counts what
    two sets share by products of 0/1 matrices, a tile at a time; shingles of one member only are left out."""
    n = np.array([len(s) for s in sets])
    ids, count = np.unique(np.concatenate(sets), return_counts=True)
    ids = ids[count > 1]
    at = [np.searchsorted(ids, s[np.isin(s, ids, assume_unique=True)]) for s in sets]
    up: dict = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    def matrix(lo: int, hi: int, first: int, last: int) -> np.ndarray:
        m = np.zeros((hi - lo, last - first), np.float32)
        for k in range(lo, hi):
            a, b = np.searchsorted(at[k], (first, last))
            m[k - lo, at[k][a:b] - first] = 1
        return m

    out = []
    for lo in range(0, len(rid), tile):
        for lo2 in range(lo, len(rid), tile):
            hi, hi2 = min(lo + tile, len(rid)), min(lo2 + tile, len(rid))
            shared = np.zeros((hi - lo, hi2 - lo2), np.float32)
            for first in range(0, len(ids), 4096):
                last = min(first + 4096, len(ids))
                left = matrix(lo, hi, first, last)
                shared += left @ (left if lo == lo2 else matrix(lo2, hi2, first, last)).T
            union = n[lo:hi, None] + n[None, lo2:hi2] - shared.astype(np.float64)
            ok = (100 * shared.astype(np.float64) >= PERCENT * union) & (comp[lo:hi, None] != comp[None, lo2:hi2])
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                i, j = i + lo, j + lo2
                if i < j:
                    x, y = sorted((int(rid[i]), int(rid[j])))
                    a, b = top(comp[i]), top(comp[j])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((x, y))
    return out


def _in_groups(batches: Iterator[pa.RecordBatch], columns: list[str], rows) -> Iterator[pa.RecordBatch]:
    """rows(table) of each run of equal first three columns; what it returns becomes rows of the given long columns."""
    out: list = []

    def whole(t: pa.Table) -> Iterator[pa.Table]:
        keys = np.column_stack([t.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield t.slice(lo, hi - lo)

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(columns))], columns)

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        groups = list(whole(t))
        rest = groups.pop() if groups else None  # may go on in the next batch; a group has some LIMIT members, in pairs of blocks twice as many
        for g in groups:
            out += rows(g)
            if len(out) > 50_000:
                yield ready()
                out = []
    if rest is not None and rest.num_rows:
        out += rows(rest)
    if out:
        yield ready()


GROUP = ["node", "one", "two", "block", "rid", "comp"]


def in_nodes(held: DataFrame) -> DataFrame:
    """The members of nodes of several components (what apart() gives), in the groups in which they are compared (node, one, two)."""
    # Up to LIMIT members outside the largest component go to every block of it; else blocks meet in pairs.
    blocks = F.ceil(F.col("size") / LIMIT)
    few = (F.col("minor") <= LIMIT) & (blocks > 1)
    held = held.withColumn("block", F.pmod(F.xxhash64("rid"), blocks))
    zero = F.lit(0).cast("long")
    one_block = held.where(blocks == 1).select("node", zero.alias("one"), zero.alias("two"), "block", "rid", "comp")
    large = held.where(blocks > 1)
    own = few & (F.col("comp") == F.col("major"))
    large = large.withColumn("other", F.explode(F.when(own, F.array("block")).otherwise(F.sequence(zero, blocks - 1))))
    one = F.when(few, F.col("other")).otherwise(F.least("block", "other"))
    two = F.when(few, F.col("other")).otherwise(F.greatest("block", "other"))
    return one_block.unionByName(large.select("node", one.alias("one"), two.alias("two"), "block", "rid", "comp"))


def with_sketch(members: DataFrame, reps: DataFrame, width: int = COORDINATES) -> DataFrame:
    """members (of GROUP) with n and the first coordinates of their sketch."""
    sketch = reps.select("rid", "n", F.substring("sketch", 1, width).alias("sketch") if width < COORDINATES else "sketch")
    return members.select(*GROUP).join(sketch, "rid").select(*GROUP, "n", "sketch")


def grouped(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "node", "one", "two").sortWithinPartitions("node", "one", "two", "rid")


def _members(t: pa.Table):
    block, rid, comp, n = (t.column(k).to_numpy() for k in (3, 4, 5, 6))
    cross = block if t.column(1)[0].as_py() != t.column(2)[0].as_py() else None
    return rid, comp, n, _bytes(t.column(7)), cross


def best_pairs(held: DataFrame) -> DataFrame:
    """a, b: for each component in each group its best candidate in another."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_groups(batches, ["a", "b"], lambda t: best_links(*_members(t)))

    return grouped(held).mapInArrow(compare, "a long, b long").distinct()


def active(held: DataFrame) -> DataFrame:
    """The members of the groups that have a candidate in another component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(t: pa.Table) -> list[tuple]:
            rid, comp, n, sketch, cross = _members(t)
            i, j, _ = doubtful(rid, comp, n, sketch, cross)
            some = np.unique(np.concatenate([i, j]))
            key = tuple(t.column(k)[0].as_py() for k in range(3))
            return [(*key, b, r, c) for b, r, c in zip(*(x[some].tolist() for x in (t.column(3).to_numpy(), rid, comp)), strict=True)]

        return _in_groups(batches, GROUP, rows)

    return grouped(held).mapInArrow(compare, ", ".join(f"{c} long" for c in GROUP))


def renamed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with their components as they are by now."""
    return members.drop("comp").join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))


def fine_sets(texts: DataFrame) -> DataFrame:
    """rid, fine: the shingles of these texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            fine = [shingle(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fine, pa.binary())], ["rid", "fine"])

    return texts.select("rid", "text").mapInArrow(make, "rid long, fine binary")


def joining_pairs(members: DataFrame, fine: DataFrame, reps: DataFrame, most: int = SHINGLES) -> DataFrame:
    """a, b: in each group, pairs with enough in common, as many as join its components. A group with more than `most`
    shingles is dealt into parts, each two of which meet; so is memory bounded by bytes."""
    sizes = members.join(reps.select("rid", "n"), "rid").groupBy("node", "one", "two").agg(F.ceil(F.sum("n") * 2 / most).alias("parts"))
    members = members.join(frozen(sizes.where("parts > 1"), "sizes"), ["node", "one", "two"], "left")
    part = F.pmod(F.xxhash64("rid", F.lit("part")), "parts")
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    members = members.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(other))
    whole = F.when(F.col("parts").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")))
    rows = members.select(whole.alias("node"), "one", "two", "rid", "comp").join(fine, "rid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> list[tuple[int, int]]:
            rid, comp = t.column(3).to_numpy(), t.column(4).to_numpy()
            if (comp == comp[0]).all():
                return []
            return exact_links(rid, comp, [np.frombuffer(x, np.uint64) for x in t.column(5).to_pylist()])

        return _in_groups(batches, ["a", "b"], pairs)

    return grouped(rows.select("node", "one", "two", "rid", "comp", "fine")).mapInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked: the exact similarity of each pair's full sets against the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, own = Shingler(), np.empty(0, np.uint64)
        for rows in batches:
            out: tuple[list, list, list] = [], [], []
            for a, b, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
                other = shingle(text.as_py())
                if b < 0:
                    own = other
                    continue
                shared = len(np.intersect1d(own, other, assume_unique=True))
                for c, x in zip(out, (min(a, b), max(a, b), 100 * shared >= PERCENT * (len(own) + len(other) - shared)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    return gathered(pairs, texts, ["text"]).mapInArrow(check, "a long, b long, linked boolean")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """rid, comp of all ends of links (a < b): comp is the component's smallest rid."""
    edges, before = frozen(links.select("a", "b").distinct(), "links"), None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select("m", "b").where("m <> b").distinct()
        low = large.groupBy("b").agg(F.min("m").alias("least"))
        small = large.join(low, "b")
        small = small.select(F.col("least").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("least").alias("a"), "b"))
        edges = frozen(small.distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("rid"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("rid"), F.col("a").alias("comp")).distinct())


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, key, n and the component: c_id, c_rid (its document with the smallest identifier)."""
    ship(docs.sparkSession)
    rows = frozen(sketches(docs, id_col, text_col), "sketches")
    full = rows.where("n > 0").select("rid", "id", "key", "n", "set")
    first, best = climb(full, ["set"], smallest=True)
    best = frozen(best.select("set", F.col("top.rid").alias("rid"), F.col("top.id").alias("top_id")), "classes")
    reps = frozen_by(rows.join(best.select("rid"), "rid", "left_semi").select("rid", "key", "n", "roots", "sketch"), "representatives", "rid")
    nodes = frozen(roots(reps), "roots")
    near = nodes.select("rid").distinct().join(reps.select("rid", "key"), "rid")
    whole, ident, text = positional(docs, id_col, text_col)
    whole = whole.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    whole = whole.select(key_of(F.col("id"), F.col("text")).alias("key"), "text").dropDuplicates(["key"])  # repeated rows: one text
    texts = frozen_by(whole.join(near, "key").select("rid", "text"), "texts", "rid")
    first_of = frozen(nodes.groupBy("node").agg(F.min("rid").alias("a")), "firsts")
    tried = [frozen(confirmed(against_one(nodes.join(first_of, "node").select("a", F.col("rid").alias("b")), reps), texts), "tried")]
    comps = components(tried[0].where("linked"))

    def learn(pairs: DataFrame) -> bool:
        """Whether the pairs, those not tried yet, changed the components."""
        nonlocal comps
        pairs = pairs.select("a", "b", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        for t in tried:
            pairs = pairs.join(t.select(F.col("a").alias("low"), F.col("b").alias("high")), ["low", "high"], "left_anti")
        new = frozen(confirmed(pairs, texts), "new")
        tried.append(new)
        if new.where("linked").isEmpty():
            return False
        links = tried[0].where("linked")
        for t in tried[1:]:
            links = links.unionByName(t.where("linked"))
        comps = components(links)
        return True

    held = frozen(apart(nodes, comps), "level")
    for k in range(1, PASSES):
        crowded = held.where(F.col("minor") > LIMIT)
        if crowded.isEmpty():
            break
        some = crowded.where("comp = major").groupBy("node").agg(F.min(F.struct(F.xxhash64("rid", "node", F.lit(k)), "rid"))["rid"].alias("a"))
        if learn(against_one(crowded.where("comp <> major").join(frozen(some, "some"), "node").select("a", F.col("rid").alias("b")), reps)):
            held = frozen(apart(nodes, comps), "level")
    if not held.where(F.col("minor") > LIMIT).isEmpty():
        held = frozen(apart(branched(held, reps, comps), comps), "trees")
    coarse = frozen(active(with_sketch(in_nodes(held), reps, COARSE)), "coarse")
    if not coarse.isEmpty():
        learn(best_pairs(with_sketch(coarse, reps)))
        members = frozen(active(with_sketch(renamed(coarse, comps), reps)), "active")
        if not members.isEmpty():
            fine = frozen(fine_sets(texts.join(members.select("rid").distinct(), "rid")), "fine")
            learn(joining_pairs(members, fine, reps))
    best = best.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = F.min(F.struct(F.col("top_id").isNull().alias("none"), F.col("top_id").alias("id"), "rid"))
    name = best.groupBy("comp").agg(least.alias("least"))
    best = best.join(name, "comp").select("set", F.col("least.id").alias("c_id"), F.col("least.rid").alias("c_rid"))
    alone = rows.where("n = 0").select("rid", "id", "key", "n", F.col("id").alias("c_id"), F.col("rid").alias("c_rid"))
    return descend(full, first, best, ["set"]).select(alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, n_shingles, component_id, kept."""
    return linked(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c_id").alias("component_id"), F.col("id").eqNullSafe(F.col("c_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, and all documents without words, with all their columns."""
    stay = linked(docs, id_col, text_col).where("rid = c_rid AND n > 0").select("key").distinct()
    rows, ident, text = positional(docs, id_col, text_col)
    blank = F.length(F.trim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))) == 0
    some = rows.where(~blank).withColumn("key", key_of(F.col(ident), F.col(text))).dropDuplicates(["key"])
    return some.join(stay, "key", "left_semi").drop("key").unionByName(rows.where(blank)).toDF(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
