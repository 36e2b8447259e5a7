"""Shared helpers: the cluster's shared folder, cut lineage, Arrow slices, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir; it goes when the session's driver ends.

    Where the setting is unset, a local session (as in tests) gets a temporary folder, and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (master := spark.conf.get("spark.master", "local")).startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def forget_at_end(spark: SparkSession, path: str) -> None:
    """The file system deletes the path when the driver's JVM ends; lazy results can read it until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, outlives executors, and runs Python code once."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    forget_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict = {}


def kept(key, make):
    """make()'s result, kept between tasks of a Python worker: one at a time, as what an operator keeps may be large."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what another operator kept in this worker."""
    _kept.clear()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a bounded number of rows, so that Python objects stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


HUB, HUBS = 10_000, 10_000


def _least(edges: DataFrame, n: int) -> DataFrame:
    """edges(u, v) with m, the smallest v of each u.

    A node with more than HUB edges and a HUBS-th of all is a hub: there are at most HUBS of them, so their smallest
    neighbours are broadcast, and only the edges of other nodes are shuffled to meet theirs.
    """
    low = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")), "least")
    bar = max(HUB, n // HUBS)
    hubs = low.where(F.col("d") > bar).select(F.col("u").alias("_h"), F.col("m").alias("_m"))
    if hubs.isEmpty():
        return edges.join(low.select("u", "m"), "u")
    told = edges.join(F.broadcast(hubs), F.col("u") == F.col("_h"), "left")
    rest = told.where("_h is null").select("u", "v").join(low.where(F.col("d") <= bar).select("u", "m"), "u")
    return told.where("_h is not null").select("u", "v", F.col("_m").alias("m")).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges(a, b), root being the smallest node that links reach.

    Alternates large-star and small-star steps on a distributed edge table. Every round is written to the shared
    folder; only one checksum a round comes to the driver. Nulls and self-links are ignored; repeated links count once.
    """
    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    n, before = cur.count(), None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(large.distinct(), "cc")
        joined = _least(large, n)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        cur = stage(small.where("u <> v").distinct(), "cc")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        n, before = now[0], now
    else:
        raise RuntimeError("components did not settle")
    star = cur.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return star.unionByName(roots)
