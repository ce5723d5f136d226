"""Shared-folder staging: cut a plan's lineage by writing a Parquet table.

A staged table survives the loss of executors (it lives in the folder the cluster
names in ``spark.checkpoint.dir``), keeps its column statistics, and is read back with
column pruning and filter push-down, which a row-format checkpoint is not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SENT = 1_000_000       # rows of a staged table up to which a join may send it to every executor


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: checkpoints, or else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tickloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def many_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Options of a writer that makes a file a key. Each task moves its files into place, not the driver one after the
    other. A local disk is different: every file, checksum and folder that is made there starts a process (chmod), and a
    move takes next to nothing, so whole folders are moved at the end and checksum files left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    version = "mapreduce.fileoutputcommitter.algorithm.version"
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return {version: "2"}
    return {version: "1", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sendable(staged: DataFrame, most: int = SENT) -> DataFrame:
    """A staged table for a join, which may broadcast it up to ``most`` rows only. The planner goes by the size of its
    files, in which numbers that repeat take next to no space; on the driver each row takes a hundred bytes."""
    return staged.hint("merge") if staged.count() > most else staged
