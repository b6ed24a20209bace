"""Streams: watched folders become document versions, work units pass barriers, costs fall into budget windows.

Every sink is idempotent: a micro-batch that runs again after a lost driver writes the same rows under the same batch
id, and a version that is there already is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """(source_ref, content, content_hash, modified_at) of files as they appear or change."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.col("path").alias("source_ref"), "content", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"))


def new_versions(observed: DataFrame, known: DataFrame, quiet_before=None) -> DataFrame:
    """Observed files whose bytes their lineage does not have yet: (source_ref, content_hash) pairs that are not known.

    quiet_before: files that changed after it wait for a later cycle.
    """
    rows = observed if quiet_before is None else observed.where(F.col("modified_at") <= quiet_before)
    return rows.dropDuplicates(["source_ref", "content_hash"]).join(known.select("source_ref", "content_hash"), ["source_ref", "content_hash"], "left_anti")


def vanished(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Lineages that the source no longer lists: deletion markers."""
    return known.select("source_ref").distinct().join(listed.select("source_ref"), "source_ref", "left_anti").withColumn("deleted", F.lit(True))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append new versions to the Parquet table at a path, a folder for each batch, until the source is drained."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            known = spark.read.parquet(table).where(F.col("batch") != batch_id)
        except Exception as missing:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = batch.limit(0)
        new_versions(batch, known).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def barrier(done: DataFrame, expected: DataFrame, key: str, unit: str = "unit_id") -> DataFrame:
    """Keys all of whose expected units are done: (key, units). A unit counts once however often it is reported."""
    finished = done.select(key, unit).distinct().groupBy(key).agg(F.count("*").alias("units"))
    return finished.join(expected, key).where(F.col("units") >= F.col("expected")).select(key, "units")


def budget(costs: DataFrame, seconds: int, lateness: str = "1 hour", at: str = "occurred_at", keys: tuple[str, ...] = ("stage", "lane")) -> DataFrame:
    """Spend of each epoch-aligned window of a stream of costs; a window is final once the watermark is past it."""
    windowed = costs.withWatermark(at, lateness).groupBy(F.window(at, f"{seconds} seconds"), *keys)
    return windowed.agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("receipts")).select(F.col("window.start").alias("window_start"), *keys, "cost_usd", "receipts")


def frozen_page(costs: DataFrame, now, lag_seconds: int = 60) -> DataFrame:
    """Costs up to a horizon behind now, so that a page that was read never gains rows."""
    return costs.where(F.col("occurred_at") <= now - F.expr(f"INTERVAL {lag_seconds} SECONDS"))
