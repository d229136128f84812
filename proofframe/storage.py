"""The folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, on a local master only, one of this user's in /tmp:
    executors of a cluster couldn't see each other's."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"/tmp/proofframe-{os.getuid()}-checkpoints"
    return base


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """df written once and read again: it isn't computed twice, its lineage ends, and lost executors lose none of it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever file system path names; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a stored table that no plan reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark's cleaner drops the shuffle files of steps that are written and
    done; else they stay until a collection happens by itself, beside those of all later steps."""
    spark._jvm.System.gc()
