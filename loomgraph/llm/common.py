"""Helpers shared by the operators of this subpackage: frozen tables in the
folder the cluster shares, and text normalisation that stays in the JVM."""

from __future__ import annotations

import atexit
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

__all__ = ["ASCII_SPACE", "ascii_lower", "documents", "frozen", "frozen_by", "positional", "row_key", "scratch_path", "shared_root", "ship", "word_count"]

#: The ASCII white space of the word rule: space and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset
    (tests, one machine) a temporary folder takes its place."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def frozen(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage
    ends there, each row keeps its values on every later read, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frozen_by(df: DataFrame, name: str, key: str, options: dict | None = None) -> DataFrame:
    """df as a table bucketed by key in the shared folder: later joins on key move only their other side."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"loomgraph_{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).options(**{"compression": "zstd"} | (options or {})).option("path", scratch_path(spark, name)).saveAsTable(table)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def positional(docs: DataFrame, *names: str) -> tuple:
    """docs with columns c0, c1, ..., and which of these the given names are. Whatever the input's columns are called
    (dots, names of one's own, names that differ in case only), nothing clashes. A name fits exactly, or else but for case."""
    own = docs.columns

    def place(name: str) -> int:
        fits = [i for i, c in enumerate(own) if c == name] or [i for i, c in enumerate(own) if c.lower() == name.lower()]
        if len(fits) != 1:
            raise ValueError(f"{len(fits)} columns are called {name!r} among {own}")
        return fits[0]

    return docs.toDF(*[f"c{i}" for i in range(len(own))]), *[f"c{place(n)}" for n in names]


def row_key(ident: Column, *rest: Column) -> Column:
    """A string that tells rows apart by identifier (null is none of the others) and what else is given."""
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), ident.cast("string")), F.lit("n")), *rest)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII texts take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    """Words of the ASCII white-space rule: word starts, counted without building the words."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    gaps = F.length(F.regexp_replace(bare, f"[{_SPACE_CLASS}]+", "\n")) - F.length(F.translate(bare, ASCII_SPACE, ""))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


_SPACE_CLASS = r"\x20\x09-\x0D"
