"""Variable-length walks and shortest paths over an edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_folder


def walks(edges: DataFrame, a: str, b: str, least: int, most: int) -> DataFrame:
    """a, b, hops of all walks of least to most edges in which no edge repeats, unrolled to so many joins."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"), F.struct(*edges.columns).alias("edge"))
    level = e.select(F.col("x").alias("a"), F.col("y").alias("b"), F.array("edge").alias("edges"))
    found = []
    for hops in range(1, most + 1):
        if hops > 1:
            level = level.join(e, F.col("b") == F.col("x")).where(~F.array_contains("edges", F.col("edge"))).select("a", F.col("y").alias("b"), F.array_append("edges", F.col("edge")).alias("edges"))
        if hops >= least:
            found.append(level.select("a", "b", F.lit(hops).alias("hops")))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def shortest_paths(edges: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """a, b, hops of the shortest path between each two different connected nodes: breadth first from all of them.
    Stops when a round finds nothing new. most: raises if there are paths of more hops."""
    shared_folder(edges.sparkSession)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    seen = e.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1).alias("hops")).checkpoint()
    level = seen
    for hops in count(2):
        new = level.join(e, F.col("b") == F.col("x")).select("a", F.col("y").alias("b")).where("a <> b").distinct()
        level = new.join(seen, ["a", "b"], "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        if level.isEmpty():
            break
        if most is not None and hops > most:
            raise RuntimeError(f"there are paths of more than {most} hops")
        seen = seen.unionAll(level)
    return seen
