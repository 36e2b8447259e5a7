"""Token ids of whole documents in ORC: run-length encoded integers, row indexes and Bloom filters on the id."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, text_or_empty
from .encoders import SpacedEncoder, encoder

END_ID = 0
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encoded(path: str, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches):
        enc, part, start = encoder(SpacedEncoder, path), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids = [x + end for x in enc.encode(b.column("text").cast(pa.binary()).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            stops = start + np.cumsum(n)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(stops - n),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start = int(stops[-1]) if len(n) else start

    return run


def write_token_orc(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, stripe_mb: int = 64, stride: int = 10_000
) -> None:
    """Write docs(doc_id, text) as ORC files in ascending doc_id order, ids of each text and then end_id.

    Null text is an empty text (only end_id); null doc_id sorts first; repeated doc_ids are all kept, in the order of
    the hash of their text; other columns are ignored. An empty table gives an empty ORC data set. Each text is one
    row, so a task's memory is bounded by a slice of 256 texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").withColumn("_h", F.xxhash64("text")).sortWithinPartitions("doc_id", "_h").drop("_h")
    (
        rows.mapInArrow(_encoded(tokenizer, end_id), SCHEMA)
        .write.option("orc.stripe.size", stripe_mb << 20)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("compression", "zstd")
        .orc(path)
    )


def _starts(rows: DataFrame) -> DataFrame:
    """part, base: ids of all parts before it. A sum a file, then a running sum over those."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Stripes are read in parallel.

    Only n_tokens and part are read to place the files one after another.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.join(_starts(rows), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter prunes files, stripes and row groups by statistics and Bloom filters."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(*doc_ids))


def _crc(batches):
    for b in slices(batches, 1024):
        lists = b.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        kept = [b.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"]
        )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the files.

    Ids turn into their crc32 where the stripe is read, so that they are not shuffled to learn a file's start.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    small = rows.mapInArrow(_crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return small.join(_starts(rows), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark) + "-tokens.orc"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_orc(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
