"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs on this machine alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "waymark-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; a lost executor then costs no recomputation.

    The table stays until `discard` or `clear`, as results that are not yet computed may read it.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the table that materialise() gave, once nothing reads it any more."""
    _delete(df.sparkSession, df._written_to)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when its results are written."""
    _delete(spark, session_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
