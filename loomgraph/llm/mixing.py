"""Mixing sources to target weights by systematic sampling.

Each source has a target in words: weights share a total, no target goes above
`most` times its source's size, and what is cut off goes to the others by
weight until none is above (solved in closed form over the table of sources,
sorted by the level at which each is full). A document's expected copies are
its source's target over its source's size. Within a source the documents stand
in order of size; the expected copies are summed up along that order, one
offset a source is added, and a document is emitted once for each integer that
its stretch of the sum crosses. As the order is by size, the words taken differ
from the target by about one document of the source's longest.

The prefix sum needs no task that holds a source: rows are dealt out by ranges
of (source, size, identifier), each range counts its rows, the counts' prefix
sums (a row per range and source) come back as offsets.

The offset is drawn from the seed and the source's name, so reruns agree.

Defined results: a null text has size 0 and is never needed (taken 0); a null
source is a source of its own, last in order; sizes of 0 throughout give
targets of 0; repeated rows are separate documents; an empty table gives an
empty result; other columns are not read by `mix` and pass through `mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, frozen, positional, row_key, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """sources (skey, source, source_size) plus target, rate (expected copies) and offset.
    One row a source: this table is as small as the list of sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ws = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("w", F.element_at(ws, (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("full_at", F.col("source_size") * most / F.col("w"))
    by = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (
        F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    ) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("at_cap", F.col("full_at") <= F.col("level"))
    s = s.withColumn("final", F.min(F.when(~F.col("at_cap"), F.struct("full_at", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.when(F.col("at_cap"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("final") * F.col("w")))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    return s.select("skey", "source_size", "target", rate.alias("rate"), drawn.alias("offset"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (skey, size, id, ...) plus rank, from 1, by size and identifier within skey."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "skey", "size", "id").withColumn("part", F.spark_partition_id())
    dealt = frozen(dealt, "ranges")
    counts = dealt.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("skey", "part").orderBy("size", "id")
    return dealt.withColumn("here", F.row_number().over(here)).join(starts, ["skey", "part"]).withColumn("rank", F.col("start") + F.col("here")).drop("part", "here", "start")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: dict | None = None, **how) -> DataFrame:
    """One row per document: identifier, size, source_size, target, copies, taken (and `extra` columns, made of identifier and text)."""
    docs, ident, text, source = positional(docs, id_col, text_col, source_col)
    source = F.col(source).cast("string")
    rows = docs.select(
        F.col(ident).alias("id"), source.alias("source"), word_count(F.col(text)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), *[c(F.col(ident), F.col(text)).alias(k) for k, c in (extra or {}).items() if c],
    )
    rows = ranked(frozen(rows, "sizes"))  # frozen: the ranges are found and dealt in two passes, and only one counts words
    sources = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rows = rows.join(source_targets(sources, **how), "skey")
    upto = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    rows = rows.withColumn("copies", upto(F.col("rank")) - upto(F.col("rank") - 1))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(extra or {}),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document of docs as often as it is taken, all columns."""
    key = lambda ident, text: row_key(ident, F.hex(F.xxhash64(text)), F.octet_length(text))
    # Rows that agree in identifier and text share their copies evenly, source by source.
    rows, ident, text, source = positional(docs, id_col, text_col, source_col)
    of = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    taken = mix(rows, ident, text, source, {"k": key, "skey": None}, **how).where("copies > 0")
    taken = taken.groupBy("k", "skey").agg(F.sum("copies").alias("n_copies"))
    counted = rows.withColumns({"k": key(F.col(ident), F.col(text)), "skey": of(F.col(source))}).join(taken, ["k", "skey"])
    one = Window.partitionBy("k", "skey")
    counted = counted.withColumns({"nth": F.row_number().over(one.orderBy(ident)), "of": F.count(F.lit(1)).over(one)})
    share = F.floor(F.col("n_copies") / F.col("of")) + F.when(F.col("nth") <= F.col("n_copies") % F.col("of"), 1).otherwise(0)
    return counted.withColumn("copy", F.explode(F.array_repeat(F.lit(1), share.cast("int")))).select(*rows.columns).toDF(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s),
f AS (SELECT *, source_size * 2 / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN full_at <= level THEN source_size * 2.0::DOUBLE
             ELSE w * (SELECT arg_min(level, full_at) FROM l WHERE full_at > level) END AS target,
             ('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate FROM t)
SELECT r.doc_id, r.size, e.source_size, e.target,
       ((floor(k * rate + u) - floor((k - 1) * rate + u)) * r.size)::BIGINT AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
