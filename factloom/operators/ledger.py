"""The work ledger: units that are claimed, finished, tried again, given up and replayed.

A ledger is a table (processing_id, target_id, stage, component_version, lane, status, enqueued_at, not_before, attempts,
last_error). Each step gives the ledger after it; one streaming micro-batch or job writes it, so that no lock is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS, BACKOFF_SECONDS = 4, 60
UNIT = ["target_id", "stage", "component_version"]


def due(work: DataFrame, now: Column, stage: str | None = None, lane: str | None = None, k: int = 1) -> DataFrame:
    """The k units that wait and may start, longest waiting first."""
    rows = work.where((F.col("status") == "pending") & (F.col("not_before") <= now))
    for column, value in (("stage", stage), ("lane", lane)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy("not_before", "enqueued_at", "processing_id").limit(k)


def enqueue(work: DataFrame, new: DataFrame) -> DataFrame:
    """The units of new that the ledger does not have yet; of repeated ones that with the smallest id."""
    first = Window.partitionBy(*UNIT).orderBy("processing_id")
    once = new.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    return once.join(work.select(*UNIT).distinct(), UNIT, "left_anti").select(*new.columns)


def complete(work: DataFrame, done: DataFrame, follow_up: DataFrame | None = None) -> DataFrame:
    """The ledger with the units of done (processing_id) finished and the follow-ups that it lacks."""
    hit = done.select("processing_id").distinct().withColumn("_done", F.lit(True))
    out = work.join(hit, "processing_id", "left").withColumn("status", F.when(F.col("_done"), "done").otherwise(F.col("status"))).drop("_done").select(*work.columns)
    return out if follow_up is None else out.unionByName(enqueue(work, follow_up))


def fail(work: DataFrame, failed: DataFrame, now: Column, attempts_most: int = ATTEMPTS, backoff: int = BACKOFF_SECONDS) -> DataFrame:
    """The ledger after failures (processing_id, error, retryable): tried again after a pause that doubles, or dead."""
    rows = work.join(failed.dropDuplicates(["processing_id"]).withColumn("_failed", F.lit(True)), "processing_id", "left")
    tried = F.when(F.col("_failed"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    gone = F.col("_failed") & (~F.coalesce("retryable", F.lit(False)) | (tried >= attempts_most))
    later = F.timestamp_seconds(F.unix_timestamp(now.cast("timestamp")) + backoff * F.pow(F.lit(2), F.col("attempts")).cast("long")).cast("timestamp_ntz")
    out = rows.withColumns(
        {
            "status": F.when(gone, "dead").when(F.col("_failed"), "pending").otherwise(F.col("status")),
            "not_before": F.when(F.col("_failed") & ~gone, later).otherwise(F.col("not_before")),
            "last_error": F.when(F.col("_failed"), F.col("error")).otherwise(F.col("last_error")),
            "attempts": tried,
        }
    )
    return out.select(*work.columns)


def replay(work: DataFrame, chosen: DataFrame, now: Column, allowance: int = 1, attempts_most: int = ATTEMPTS) -> DataFrame:
    """The ledger with the dead units of chosen (processing_id) open again, for as many attempts as allowed."""
    rows = work.join(chosen.select("processing_id").distinct().withColumn("_chosen", F.lit(True)), "processing_id", "left")
    again = F.col("_chosen") & (F.col("status") == "dead")
    out = rows.withColumns(
        {
            "attempts": F.when(again, F.greatest(F.lit(0), F.lit(attempts_most - allowance))).otherwise(F.col("attempts")).cast("int"),
            "not_before": F.when(again, now).otherwise(F.col("not_before")),
            "status": F.when(again, "pending").otherwise(F.col("status")),
        }
    )
    return out.select(*work.columns)


def backfill(work: DataFrame, stage: str, version: str, now: Column) -> DataFrame:
    """Units of a stage for a new component version: one for each target that has been through it and lacks this one."""
    targets = work.where(F.col("stage") == stage).select("target_id").distinct()
    new = targets.select(F.concat_ws(":", F.lit("fill"), F.lit(stage), F.lit(version), "target_id").alias("processing_id"), "target_id", F.lit(stage).alias("stage"), F.lit(version).alias("component_version"), F.lit("backfill").alias("lane"), now.alias("enqueued_at"))
    return enqueue(work, new)


def readiness(work: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(target_id, a count of done units for each stage, open_units, dead_units, ready)."""
    counts = [F.count_if((F.col("stage") == s) & (F.col("status") == "done")).alias(s) for s in stages]
    out = work.groupBy("target_id").agg(*counts, F.count_if(F.col("status") == "pending").alias("open_units"), F.count_if(F.col("status") == "dead").alias("dead_units"))
    every = F.lit(True)
    for s in stages:
        every = every & (F.col(s) > 0)
    return out.withColumn("ready", every & (F.col("open_units") == 0) & (F.col("dead_units") == 0))
