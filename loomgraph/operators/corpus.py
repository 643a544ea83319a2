"""Corpus analytics: duplicate groups, version audits, propagation, rule scans, profiles and gates."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

# --- duplicate groups -------------------------------------------------------------------------------------------------


def exact_groups(units: DataFrame, hash_col: str, uid_col: str, lines_col: str, prefix: str = "exact") -> DataFrame:
    """Groups of at least two units with equal hash, numbered by size, then lines, then first uid."""
    groups = units.groupBy(F.col(hash_col).alias("hash")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(lines_col).cast("long").alias("total_lines"), F.min(uid_col).alias("first_uid"),
    ).where("n >= 2")
    order = Window.orderBy(F.desc("n"), F.desc("total_lines"), "first_uid")
    return groups.withColumn("group_id", F.concat(F.lit(f"{prefix}-"), F.row_number().over(order).cast("string")))


def group_members(units: DataFrame, groups: DataFrame, hash_col: str) -> DataFrame:
    return units.join(groups.select("hash", "group_id"), F.col(hash_col) == F.col("hash")).drop("hash")


def ratio(left: str, right: str, autojunk: bool = True) -> float:
    return SequenceMatcher(None, left, right, autojunk).ratio()


def candidate_pairs(units: DataFrame, uid_col: str, size_col: str, hash_col: str) -> DataFrame:
    """Pairs l before r in (size, uid) order with size_r <= int(1.25 size_l) + 8 and different hash.

    The band is an equi-join: sizes fall into classes by powers of 1.25 (a few are put together below 64, where the
    constant counts), and a partner is at most two classes away.
    """
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(64)).cast("double")) / F.log(F.lit(1.25)))
    u = units.select(F.col(uid_col).alias("uid"), F.col(size_col).alias("size"), F.col(hash_col).alias("hash"), band(size_col).alias("band"))
    left = u.select(F.col("uid").alias("l_uid"), F.col("size").alias("l_size"), F.col("hash").alias("l_hash"), F.explode(F.sequence(F.col("band"), F.col("band") + 2)).alias("band"))
    right = u.select(F.col("uid").alias("r_uid"), F.col("size").alias("r_size"), F.col("hash").alias("r_hash"), "band")
    before = (F.col("l_size") < F.col("r_size")) | ((F.col("l_size") == F.col("r_size")) & (F.col("l_uid") < F.col("r_uid")))
    inside = F.col("r_size") <= F.floor(F.col("l_size") * 1.25) + 8
    return left.join(right, "band").where(before & inside & (F.col("l_hash") != F.col("r_hash"))).select("l_uid", "l_size", "r_uid", "r_size")


LETTERS, BLOCK = 128, 256


def close_pairs(units: DataFrame, uid_col: str, text_col: str, size_col: str, hash_col: str, threshold: float) -> DataFrame:
    """The candidate pairs whose ratio can reach the threshold, none left out: a ratio is at most 1 - d / t, where d is the
    sum of the differences of character counts and t the length of both texts. Counts of characters that fall together
    (code point mod LETTERS) or stop at 65,535 only make d smaller.

    Texts of a band are dealt into blocks of about BLOCK, and a task holds the counts of two blocks at a time; only
    the counts travel, and only the pairs that pass are rows.
    """

    @F.pandas_udf("binary")
    def counts(text: pd.Series) -> pd.Series:
        return pd.Series([np.minimum(np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS), 65_535).astype(np.uint16).tobytes() for t in text])

    band = F.floor(F.log(F.greatest(F.col(size_col), F.lit(64)).cast("double")) / F.log(F.lit(1.25)))
    u = units.where(F.col(text_col).isNotNull() & F.col(size_col).isNotNull() & F.col(hash_col).isNotNull() & F.col(uid_col).isNotNull())
    u = u.select(F.col(uid_col).alias("uid"), F.col(size_col).cast("long").alias("size"), F.col(hash_col).alias("hash"), F.length(text_col).alias("len"), counts(text_col).alias("counts"), band.alias("band"))
    sizes = u.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # as many rows as sizes have powers of 1.25
    u = u.join(F.broadcast(sizes), "band").withColumn("block", F.pmod(F.xxhash64("uid", "hash"), F.col("blocks")))
    row = F.struct("uid", "size", "hash", "len", "counts")
    blocks = u.groupBy("band", "block").agg(F.collect_list(row).alias("rows"))
    left = blocks.select(F.explode(F.sequence(F.col("band"), F.col("band") + 2)).alias("at"), F.col("band").alias("l_band"), F.col("block").alias("l_block"), F.col("rows").alias("l"))
    right = blocks.select(F.col("band").alias("at"), F.col("block").alias("r_block"), F.col("rows").alias("r"))
    # inside a band either row of a pair may be the left one; decide() settles that, so each two blocks meet once
    both = left.join(right, "at").where((F.col("at") > F.col("l_band")) | (F.col("l_block") <= F.col("r_block"))).select("l", "r")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks)
    kind = u.schema["uid"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows):
            uid, size, hash_, n, c = (rows.field(k) for k in range(5))
            return uid, size.to_numpy(), np.array(hash_.to_pylist(), object), n.to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, LETTERS).astype(np.int32)

        for b in batches:
            for k in range(b.num_rows):
                l_uid, l_size, l_hash, l_len, l_counts = block(b.column(0)[k].values)
                r_uid, r_size, r_hash, r_len, r_counts = block(b.column(1)[k].values)
                l_id, r_id = (np.array(x.to_pylist(), object) for x in (l_uid, r_uid))
                found: tuple[list, list] = [], []
                for i in range(len(l_id)):
                    both = np.maximum(l_len[i] + r_len, 1)
                    near = np.flatnonzero(1 - np.abs(r_counts - l_counts[i]).sum(1) / both >= threshold - 1e-9)
                    for j in near.tolist():
                        x, y = (l_size[i], l_id[i]), (r_size[j], r_id[j])
                        if x == y or l_hash[i] == r_hash[j]:
                            continue
                        low, high = (x, y) if x < y else (y, x)
                        if high[0] <= low[0] * 5 // 4 + 8:
                            found[0].append(low[1])
                            found[1].append(high[1])
                yield pa.RecordBatch.from_arrays([pa.array(found[0], l_uid.type), pa.array(found[1], r_uid.type)], ["l_uid", "r_uid"])

    return both.mapInArrow(decide, f"l_uid {kind}, r_uid {kind}").distinct()


def budget_used(units: DataFrame, uid_col: str, size_col: str, hash_col: str, budget: int) -> DataFrame:
    """One row: compared (budget + 1 if there are more candidates than the budget), truncated."""
    n = F.count(F.lit(1))
    return candidate_pairs(units, uid_col, size_col, hash_col).limit(budget + 1).agg(n.alias("compared"), (n > budget).alias("truncated"))


def similar_pairs(units: DataFrame, uid_col: str, text_col: str, size_col: str, hash_col: str, threshold: float = 0.9, budget: int | None = 50_000, autojunk: bool = True) -> DataFrame:
    """l_uid, r_uid, similarity of candidate pairs at or above the threshold. budget: so many pairs are compared at most
    (a setting of the operator; `budget_used` tells whether it cut), the first in (size, uid) order of left and right; None
    decides all of them."""
    if budget is None:
        pairs = close_pairs(units, uid_col, text_col, size_col, hash_col, threshold)
    else:
        pairs = candidate_pairs(units, uid_col, size_col, hash_col).orderBy("l_size", "l_uid", "r_size", "r_uid").limit(budget)
    text = units.select(F.col(uid_col).alias("u"), F.col(text_col).alias("t"))
    both = pairs.join(text.toDF("l_uid", "l_text"), "l_uid").join(text.toDF("r_uid", "r_text"), "r_uid")
    both = both.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # small rows that take long to compare

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b, autojunk).ratio() for a, b in zip(left, right, strict=True)])

    return both.select("l_uid", "r_uid", similarity("l_text", "r_text").alias("similarity")).where(F.col("similarity") >= threshold)


def connected_components(edges: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """uid, component (the smallest uid) by min-label propagation with pointer jumping.
    Lineage is cut with checkpoint(), in the folder of spark.checkpoint.dir."""
    shared_folder(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).checkpoint()
    for _ in range(most):
        heard = both.join(labels.toDF("y", "label"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        near = labels.join(heard, "x").select("x", F.least("label", "heard").alias("label"))
        up = near.select(F.col("x").alias("at"), F.col("label").alias("up"))
        new = near.join(up, F.col("label") == F.col("at")).select("x", F.least("label", "up").alias("label")).checkpoint()
        if new.join(labels.toDF("x", "old"), "x").where("label <> old").isEmpty():
            return new.toDF("uid", "component")
        labels = new
    raise RuntimeError("components did not settle")


def similar_groups(units: DataFrame, uid_col: str, text_col: str, size_col: str, hash_col: str, threshold: float = 0.9, budget: int | None = 50_000, autojunk: bool = True) -> DataFrame:
    """component, members (sorted), n, similarity (the highest within, 4 places), of clusters by single linkage."""
    pairs = similar_pairs(units, uid_col, text_col, size_col, hash_col, threshold, budget, autojunk).persist()
    parts = connected_components(pairs, "l_uid", "r_uid")
    best = pairs.join(parts, F.col("l_uid") == F.col("uid")).groupBy("component").agg(F.bround(F.max("similarity"), 4).alias("similarity"))
    groups = parts.groupBy("component").agg(F.array_sort(F.collect_list("uid")).alias("members"), F.count(F.lit(1)).alias("n"))
    return groups.join(best, "component")


# --- version audits ---------------------------------------------------------------------------------------------------


def version_groups(entries: DataFrame, key: str, value: str, place: Column, min_occurrences: int = 2) -> DataFrame:
    """key, occurrences, distinct_values, status (conflict: several values, else duplicate), values with their places."""
    keyed = entries.where(F.col(key).isNotNull() & (F.length(F.col(value).cast("string")) > 0)).select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), place.alias("place"))
    by_value = keyed.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("place")).alias("places"))
    groups = by_value.groupBy("key").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_values"),
        F.array_sort(F.collect_list(F.struct("value", "n", "places"))).alias("values"),
    ).where(F.col("occurrences") >= max(2, min_occurrences))
    return groups.withColumn("status", F.when(F.col("distinct_values") > 1, "conflict").otherwise("duplicate"))


def reachable(dependencies: DataFrame, internal: DataFrame) -> DataFrame:
    """consumer, dependency, path: what each module reaches through internal modules, its direct dependencies left out.

    dependencies (module, key); internal (key): modules that are expanded. A dependency that is on the path already
    gives a row but is not followed; one equal to the consumer is skipped. All simple paths are rows, so this is for
    module trees; beyond spark.sql.cteRecursionLevelLimit levels or cteRecursionRowLimit rows Spark raises, nothing is cut.
    """
    deps, mods = dependencies.select("module", "key").distinct(), internal.select("key").distinct()
    spark = dependencies.sparkSession
    deps.createOrReplaceTempView("__lg_deps")
    mods.createOrReplaceTempView("__lg_mods")
    return spark.sql("""
        WITH RECURSIVE walk(consumer, at, path, level, go) AS (
          SELECT d.module, d.key, array(d.module, d.key), 1, d.key <> d.module FROM __lg_deps d JOIN __lg_mods m ON d.key = m.key
          UNION ALL
          SELECT w.consumer, d.key, array_append(w.path, d.key), w.level + 1,
                 NOT array_contains(w.path, d.key) AND d.key IN (SELECT key FROM __lg_mods)
          FROM walk w JOIN __lg_deps d ON w.at = d.module WHERE w.go AND d.key <> w.consumer
        ) SELECT DISTINCT consumer, at AS dependency, array_join(path, ' -> ') AS path FROM walk WHERE level > 1""")


def direct_flag(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """Dependency paths with `direct`: whether the module declares the key itself."""
    own = declared.select("module", "key").distinct().withColumn("__own", F.lit(True))
    return paths.join(own, ["module", "key"], "left").withColumn("direct", F.coalesce("__own", F.lit(False))).drop("__own")


# --- rule scans -------------------------------------------------------------------------------------------------------

#: Rule, severity, pattern.
PATTERNS = [
    ("absolute-posix-path", "high", r"(?<![\w.])/(Users|home|private|var|opt|tmp|data|mnt|Volumes|srv)/[A-Za-z0-9._~@%+=,:/\-]+"),
    ("windows-absolute-path", "high", r"[A-Za-z]:\\+[A-Za-z0-9._~ @%+=,:\\\-]+"),
    ("file-url", "high", r"file:///[A-Za-z0-9._~@%+=,:/\-]+"),
    ("hard-coded-localhost-url", "medium", r"https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)(:[0-9]+)?(/[A-Za-z0-9._~@%+=,:/?#&\-]*)?"),
    ("probable-fully-qualified-name", "medium", r"\b[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*){3,}\.[A-Z][A-Za-z0-9_]*\b"),
]
ADVICE = {
    "absolute-posix-path": "take the path from configuration, or make it relative",
    "windows-absolute-path": "take the path from configuration, so that it holds on any system",
    "file-url": "address the file through the storage that the target uses",
    "hard-coded-localhost-url": "name the host in configuration or in a test fixture",
    "probable-fully-qualified-name": "check whether this name still exists; import what the target has instead",
}
RULES = [(*p, ADVICE[p[0]]) for p in PATTERNS]
TOKEN_ADVICE = "a word of the old system: rename it, or note why it stays"
SEVERITIES = ["low", "medium", "high"]
#: Line breaks as a text's splitlines sees them.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def token_rules(tokens: list[str]) -> list[tuple[str, str, str, str]]:
    """Literal rules, numbered from 1 with blank tokens counted; the pattern is quoted."""
    return [(f"legacy-token-{k}", "high", "\\Q" + t.strip().replace("\\E", "\\E\\\\E\\Q") + "\\E", TOKEN_ADVICE) for k, t in enumerate(tokens, 1) if t.strip()]


def numbered_lines(texts: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, line (from 1), value. A break at the end of a text opens no line."""
    text = F.regexp_replace(F.col(text_col), f"(?:{LINE_BREAK})\\z", "")
    rows = texts.where(F.length(text_col) > 0).select(F.col(path_col).alias("path"), F.posexplode(F.split(text, LINE_BREAK)).alias("at", "value"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "value")


def excerpt(line: Column, start: Column, longest: int = 180) -> Column:
    """The stripped line, cut to `longest` around start with dots; start counts in the line as it was."""
    value = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    centre = F.greatest(F.lit(0), start - longest // 3)
    cut = F.concat(F.when(centre > 0, "...").otherwise(""), F.substring(value, centre + 1, F.lit(longest)), F.when(centre + longest < F.length(value), "...").otherwise(""))
    return F.when(F.length(value) <= longest, value).otherwise(cut)


def _matches(rule: str, severity: str, pattern: str, advice: str) -> Column:
    """The rule's matches in `value`, each with where it starts; null if there is none."""
    whole = f"({pattern})"
    between = F.split(F.regexp_replace("value", whole, "\u0000"), "\u0000")  # the text before each match
    hits = F.regexp_extract_all("value", F.lit(whole), F.lit(1))

    def one(hit, i):
        before = F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x))
        passed = F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda n, x: n + F.length(x))
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(advice).alias("recommendation"), (before + passed).alias("start"))

    return F.when(F.size(hits) > 0, F.transform(hits, one))


def scan(texts: DataFrame, path_col: str, text_col: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """rule, severity, path, line, excerpt, recommendation: a row a match. One pass over the lines for all rules."""
    lines = numbered_lines(texts, path_col, text_col)
    found = [_matches(*rule) for rule in rules]
    empty = F.array().cast("array<struct<rule:string,severity:string,recommendation:string,start:int>>")
    rows = lines.select("path", "line", "value", F.explode(F.concat(*[F.coalesce(f, empty) for f in found])).alias("m"))
    return rows.select("m.rule", "m.severity", "path", "line", excerpt(F.col("value"), F.col("m.start")).alias("excerpt"), "m.recommendation")


def severity_gate(findings: DataFrame, threshold: str) -> DataFrame:
    """One row: failed, whether a finding is at or above the threshold ("none" never fails)."""
    bad = SEVERITIES[SEVERITIES.index(threshold):] if threshold in SEVERITIES else []
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin(bad)), F.lit(False)).alias("failed"), F.count_if(F.col("severity").isin(bad)).alias("n"))


# --- checklists and profiles ------------------------------------------------------------------------------------------

STATUSES, CHECKS = ("TODO", "IN_PROGRESS", "DONE", "BLOCKED"), ("PENDING", "OK", "FAIL")


def progress(tasks: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """done, total, percent (half to even; 0 without tasks)."""
    done, total = F.count_if(F.col(status) == "DONE"), F.count(F.lit(1))
    percent = F.when(total == 0, 0).otherwise(F.bround(done * 100 / total, 0)).cast("int")
    return tasks.groupBy(*(by or [])).agg(done.alias("done"), total.alias("total"), percent.alias("percent"))


def gate(tasks: DataFrame, status: str = "status", check: str = "check", by: list[str] | None = None) -> DataFrame:
    """gate: FAIL if a check failed, PASS if all are done and OK, else PENDING."""
    fail, ok = F.bool_or(F.col(check) == "FAIL"), F.bool_and((F.col(status) == "DONE") & (F.col(check) == "OK"))
    return tasks.groupBy(*(by or [])).agg(F.when(fail, "FAIL").when(ok, "PASS").otherwise("PENDING").alias("gate"))


def invalid_tasks(tasks: DataFrame, status: str = "status", check: str = "check") -> DataFrame:
    return tasks.where(~F.col(status).isin(*STATUSES) | ~F.col(check).isin(*CHECKS) | F.col(status).isNull() | F.col(check).isNull())


def upsert_tasks(tasks: DataFrame, changes: DataFrame, key: str = "task_id") -> DataFrame:
    """Keyed update or append; a null in a change leaves what was there."""
    c = changes.select(*[F.col(x).alias(f"new_{x}") for x in changes.columns])
    j = tasks.join(c, F.col(key) == F.col(f"new_{key}"), "full_outer")
    return j.select(*[F.coalesce(F.col(f"new_{x}"), F.col(x)).alias(x) if x in changes.columns else F.col(x) for x in tasks.columns])


def insert_new(tasks: DataFrame, more: DataFrame, key: str = "task_id") -> DataFrame:
    return tasks.unionByName(more.join(tasks.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def top_counts(rows: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Frequencies, the most common first, ties by value."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)
    return counts if n is None else counts.limit(n)


def any_token(texts: DataFrame, text_col: str, rules: dict[str, list[str]]) -> DataFrame:
    """name of each rule of which a token occurs in some text (in lower case)."""
    low = F.lower(text_col)
    flags = [F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [low.contains(t) for t in tokens])), F.lit(False)).alias(name) for name, tokens in rules.items()]
    wide = texts.agg(*flags)
    names = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in rules]), lambda x: x.isNotNull())
    return wide.select(F.explode(names).alias("name"))


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")


# --- tree logs --------------------------------------------------------------------------------------------------------


def tree_parents(lines: DataFrame, group: str, line: str, depth: str, name: str) -> DataFrame:
    """lines with parent (name of the nearest line above with depth - 1) and tree_path from the root, by windows: one for
    each depth that occurs, which a first pass over the depths finds out."""
    deepest = lines.agg(F.max(depth)).first()[0] or 0
    upto = Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col(depth) == d, F.col(name)), ignorenulls=True).over(upto) for d in range(deepest + 1)]
    rows = lines.withColumn("__last", F.array(*last))
    parent = F.when(F.col(depth) > 0, F.element_at("__last", F.col(depth)))
    return rows.withColumn("parent", parent).withColumn("tree_path", F.array_join(F.slice("__last", 1, F.col(depth) + 1), " -> ")).drop("__last")


def carry_forward(lines: DataFrame, group: str, line: str, header: Column, name: str) -> DataFrame:
    """lines with the last header at or above each."""
    upto = Window.partitionBy(group).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(upto))


def fingerprint_join(listing: DataFrame, snapshot: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """listing with `fresh`: whether the snapshot has the key with equal marks, so its result can be used again."""
    same = [F.col(m) == F.col(f"__{m}") for m in marks]
    old = snapshot.select(F.col(key).alias("__key"), *[F.col(m).alias(f"__{m}") for m in marks])
    j = listing.join(old, reduce(lambda a, b: a & b, [F.col(key) == F.col("__key"), *same]), "left")
    return j.withColumn("fresh", F.col("__key").isNotNull()).drop("__key", *[f"__{m}" for m in marks])
