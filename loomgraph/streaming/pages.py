"""Collecting a paged API with durable progress: items to one table, failed pages to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paged_json


def collect(spark: SparkSession, options: dict, items_path: str, errors_path: str, checkpoint: str, interval: str | None = "300 milliseconds", until_done: bool = True):
    """Starts the collection; it resumes from the checkpoint. A failed page is recorded and skipped."""
    paged_json.register(spark)

    def store(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.where("error IS NULL").drop("error").write.mode("append").parquet(items_path)
        batch.where("error IS NOT NULL").select("page", "error", F.lit(epoch).alias("epoch")).write.mode("append").parquet(errors_path)
        batch.unpersist()

    stream = spark.readStream.format("paged_json").options(**options).load().writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    stream = stream.trigger(processingTime=interval) if interval else stream
    query = stream.start()
    if until_done:
        query.processAllAvailable()
        query.stop()
    return query


def export_array(items: DataFrame, path: str) -> None:
    """The collected items, in order, as one pretty JSON array on the driver: for results that fit there."""
    import json

    rows = items.orderBy("page", "position").select("item").collect()
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r.item) for r in rows], f, ensure_ascii=False, indent=2)
