"""Tables in the cluster's shared folder, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir; `forget` what is written there.

    Where the setting is unset, a local session (as in tests) gets a temporary folder, and a cluster an error.
    """
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if not (master := spark.conf.get("spark.master", "local")).startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """The path, which is there now, goes when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what lies at the path now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to a new table of the shared folder (see `shared_path`, or the path given) and read back; it goes when the driver ends."""
    path = path or shared_path(df.sparkSession)
    df.write.parquet(path)
    forget(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
