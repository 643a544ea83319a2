"""Exact dedup by a tree merge of sorted digest runs.

Every input partition becomes a run: its rows' digests, one entry a digest with
the best row and the count. Runs merge in rounds along a binomial tree: in an
exchange run r goes to run r >> bits, which takes two binomial rounds at once
(`fan_in` 4, a multiway merge) or one (`fan_in` 2). A run is cut into slices, the
ranges of its digests by their first 16 bits; a slice of the runs that meet is
put in order of the digests explicitly and merged along that order, and an entry
that survives keeps the best row of all that it stands for. So no task holds a
whole run, and a text that makes up a third of the corpus is one entry a run
after the first step. The way back follows the same tree: winners go to the
entries of the first level (at most one a partition and digest), and from there
to the rows of that run.

Digests are SHA-256 of the normalised text in UTF-8; a group must also agree in
byte length and in an independent 64-bit hash, at every level.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null identifier ranks below all others; of rows with equal text and
equal identifier exactly one (any) is kept; an empty table gives an empty
result; other columns of the input are never read by `exact_dedup` and pass
through `keep_distinct` untouched, whatever their names (private names, dots,
names that differ from others in case only).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, frozen, positional, row_key

KEYS = ["sha", "n_bytes", "check"]


FAN_IN = 4


def sorted_runs(level: DataFrame, keys: list[str]) -> DataFrame:
    """Each run (run, *keys, ...) in slices by the first 16 bits of its digests, each slice in order."""
    cut = level.withColumn("slice", F.substring(keys[0], 1, 4 if level.schema[keys[0]].dataType.simpleString() == "string" else 2))
    return cut.repartition("run", "slice").sortWithinPartitions("run", "slice", *keys)


def merge_runs(level: DataFrame, keys: list[str], n_runs: int, best=F.max, fan_in: int = FAN_IN) -> DataFrame:
    """Merges runs (run, *keys, top, n), fan_in at a time, round by round down to one."""
    bits = max(1, int(math.log2(fan_in)))
    while n_runs > 1:
        met = sorted_runs(level.withColumn("run", F.shiftright("run", bits)), keys)
        # neither an exchange nor a sort of its own: the merge goes along the order of the slices
        level = met.groupBy("run", "slice", *keys).agg(best("top").alias("top"), F.sum("n").alias("n")).drop("slice")
        n_runs = -(-n_runs // (1 << bits))
    return level


def climb(rows: DataFrame, keys: list[str], smallest: bool = False, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """rows (rid, id, *keys): the entries (run, *keys) of the first level, and of the last (*keys, top, n).
    top is the row with the largest (or smallest) id; a null id never beats another. rid must be unique and
    frozen; its upper bits are the partition that the row came from."""
    best = F.min if smallest else F.max
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "rid") if smallest else F.struct("id", "rid")
    n_runs = (rows.agg(F.max(F.shiftright("rid", 33))).first()[0] or 0) + 1
    first = rows.groupBy(F.shiftright("rid", 33).alias("run"), *keys).agg(best(rank).alias("top"), F.count(F.lit(1)).alias("n"))
    return first.select("run", *keys), merge_runs(first, keys, n_runs, best, fan_in).drop("run")


def descend(rows: DataFrame, first: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of best (one row of each *keys): by way of each run's entries, so a key that many rows share is one row a run."""
    down = first.join(best, keys)
    return rows.withColumn("run", F.shiftright("rid", 33)).join(down, ["run", *keys]).drop("run")


def elect(rows: DataFrame, keys: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """rows (rid, id, *keys) plus top_id, top_rid (the row with the largest id of equal keys) and group_size."""
    first, best = climb(rows, keys, fan_in=fan_in)
    best = best.select(*keys, F.col("top.id").alias("top_id"), F.col("top.rid").alias("top_rid"), F.col("n").alias("group_size"))
    return descend(rows, first, best, keys)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs, ident, text = positional(docs, id_col, text_col)
    return (
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(ident).alias("id"), ascii_lower(F.coalesce(text, F.lit(""))).alias("t"))
        .select("rid", "id", F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: its identifier, keep_id, group_size, kept, text_sha256."""
    rows = elect(frozen(digests(docs, id_col, text_col), "digests"), KEYS, fan_in)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("top_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, fan_in).where("kept")
    winners = kept.toDF("id", "keep_id", "group_size", "kept", "sha").select(row_key(F.col("id"), F.col("sha")).alias("k"))
    rows, ident, text = positional(docs, id_col, text_col)
    keyed = rows.withColumn("k", row_key(F.col(ident), F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)))
    # repeated rows: one stays, and is picked before the exchange where they meet
    return keyed.dropDuplicates(["k"]).join(winners, "k", "left_semi").drop("k").toDF(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM h
"""
