"""Cutting lineage: a table written to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/factloom-tables/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joined_where_dealt(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, tables dealt by some of their join keys are joined where they are, and not dealt again by all keys."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the session's JVM ends.

    Files outlive executors, and later plans start from a scan, so that a deep stack of views stays quick to plan.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    with joined_where_dealt(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
