"""Exact top-k by inner product with a bit-sliced index: bitmap sums, then selection from the highest slice down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

SCALE, TOP, EVERY = 256, 5, 50
BLOCK_ROWS = 16_384
#: Queries of a block: as many as give TASKS pairs of blocks, between these bounds; the index is copied to each block of queries.
LEAST_QUERIES, MOST_QUERIES, TASKS = 64, 16_384, 48
#: Products of components below this have 34 digits: sums of up to 10,000 of them are a decimal.
WIDEST = 1 << 56
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Vectors that are null or hold null or non-finite components go.

    So do those with a component of 2**56 or more after scaling, whose sums no decimal of 38 digits holds for certain.
    """
    e = F.col("embedding").cast("array<double>")
    v = F.transform(e, lambda x: F.floor(x * scale).cast("long"))
    fine = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * scale) < float(WIDEST)), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), fine.alias("_fine")).where("_fine").drop("_fine")


def _matrix(lists: list[list[int]]) -> np.ndarray:
    width = max(1, *map(len, lists))
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def slice_block(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each column's smallest value, and its bitmaps: the bits of what lies above that, lowest first, padded to words."""
    base = values.min(axis=0)
    above = (values - base).view(np.uint64)
    words = -(-len(values) // 64)
    out = []
    for col in above.T:
        n = int(col.max()).bit_length()
        maps = np.zeros((n, words * 8), np.uint8)
        for b in range(n):
            packed = np.packbits(((col >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            maps[b, : len(packed)] = packed
        out.append(maps.view(np.uint64))
    return base, out


def digits(q: int) -> list[tuple[int, int]]:
    """Signed binary digits (sign, power) of q, no two next to each other: fewest bitmaps to add."""
    out, power = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((d, power))
            q -= d
        q >>= 1
        power += 1
    return out


def add_slices(query: list[int], base: np.ndarray, maps: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Slices of the rows' inner products with the query, lowest first, and the constant to add.

    A slice of weight w joins column w; three bitmaps of a column become their sum there and their carry in the next,
    until each column has one. A negative digit adds the complement, which is its value less a constant.
    """
    columns: dict[int, list] = {}
    constant = 0
    for q, low, slices in zip(query, base.tolist(), maps, strict=False):
        constant += q * low
        for sign, power in digits(q):
            if sign < 0:
                constant -= ((1 << len(slices)) - 1) << power
            for s in range(len(slices)):
                columns.setdefault(power + s, []).append(slices[s] if sign > 0 else ~slices[s])
    out, w = [], 0
    words = max((m.shape[1] for m in maps if len(m)), default=0)
    while w <= max(columns, default=-1):
        col = columns.get(w, [])
        while len(col) > 2:
            rest = []
            for i in range(0, len(col) - 2, 3):
                a, b, c = col[i : i + 3]
                x = a ^ b
                rest.append(x ^ c)
                columns.setdefault(w + 1, []).append((a & b) | (x & c))
            col = rest + col[len(col) - len(col) % 3 :]
        if len(col) == 2:
            columns.setdefault(w + 1, []).append(col[0] & col[1])
            col = [col[0] ^ col[1]]
        out.append(col[0] if col else np.zeros(words, np.uint64))
        w += 1
    return out, constant


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: list[np.ndarray], allowed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest sums among the allowed, ties to the smaller id.

    From the highest slice down, rows with the bit set are in if they are few enough; else only they stay in question.
    Rows in question at the end are equal: the smallest ids fill up.
    """
    sure, maybe = np.zeros_like(allowed), allowed
    for s in reversed(slices):
        ones = maybe & s
        n = count(sure) + count(ones)
        if n > k:
            maybe = ones
        else:
            sure, maybe = sure | ones, maybe & ~s
            if n == k:
                maybe = np.zeros_like(maybe)
                break
    have, tied = rows_of(sure), rows_of(maybe)
    if len(have) < k and len(tied):
        tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(have)]]
        have = np.concatenate([have, tied])
    return have


def _index(block_rows: int):
    """Blocks of rows: number of the block, ids, smallest values, bitmaps with their counts."""

    def flush(ids: list, lists: list, no: int):
        values = _matrix(lists)
        base, maps = slice_block(values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 32) + no]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([base.tobytes()], pa.binary()), pa.array([np.array([len(m) for m in maps], np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(m.tobytes() for m in maps)], pa.binary()),
            ],
            names=["block", "ids", "base", "counts", "maps"],
        )

    def run(batches):
        ids, lists, no = [], [], 0
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            lists += b.column("v").to_pylist()
            while len(ids) >= block_rows:
                yield flush(ids[:block_rows], lists[:block_rows], no)
                ids, lists, no = ids[block_rows:], lists[block_rows:], no + 1
        if ids:
            yield flush(ids, lists, no)

    return run


INDEX = "block long, ids binary, base binary, counts binary, maps binary"


def _search(k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, base = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["base"], np.int64)
                counts, words = np.frombuffer(row["counts"], np.int64), -(-len(ids) // 64)
                flat, maps, at = np.frombuffer(row["maps"], np.uint64), [], 0
                for n in counts.tolist():
                    maps.append(flat[at : at + n * words].reshape(n, words))
                    at += n * words
                full = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
                out: list[tuple] = []
                for q_id, q in zip(row["q_ids"], row["q_vs"], strict=True):
                    slices, constant = add_slices(q, base, maps)
                    allowed = full & ~np.packbits(np.resize(ids == q_id, words * 64) & (np.arange(words * 64) < len(ids)), bitorder="little").view(np.uint64)
                    got = top_rows(slices, allowed, ids, k)
                    bits = [((s[got >> 6] >> (got & 63).astype(np.uint64)) & np.uint64(1)).tolist() for s in slices]
                    scores = [constant + sum(b[i] << w for w, b in enumerate(bits)) for i in range(len(got))]
                    out += zip([q_id] * len(got), ids[got].tolist(), [str(x) for x in scores], strict=True)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    Rows become blocks of bitmaps once; blocks of queries meet every block of rows, and only k rows a query and block
    go on. Ties go to the smaller vec_id. Sums are exact integers of any width; a score beyond a long is given as the
    nearest long, its rank stays exact. Vectors with null or non-finite components take no part, nor do null ids or
    components of 2**56 or more after scaling; an empty vector's components and the missing ones of shorter vectors are 0; rows
    that repeat a query's id are its own; repeated query ids are answered once; other columns are ignored; empty
    tables give no row.
    """
    index = quantised(vectors, scale).where("vec_id is not null").mapInArrow(_index(BLOCK_ROWS), INDEX)
    index = stage(index, "bit-slices")
    asked = stage(quantised(queries, scale).where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_index = max(1, index.count())
    size = min(MOST_QUERIES, max(LEAST_QUERIES, asked.count() * n_index // TASKS))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(asked.count() // size + 1)))
    asked = asked.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("q"))  # MOST_QUERIES or so
    asked = asked.select("qb", F.col("q.vec_id").alias("q_ids"), F.col("q.v").alias("q_vs"))
    # a query set against all rows, in blocks: query blocks are copied to each row block, not rows to rows
    number = index.select("block", F.row_number().over(Window.orderBy("block")).alias("no"))  # a row a block
    met = asked.withColumn("no", F.explode(F.sequence(F.lit(1), F.lit(n_index))))
    pairs = met.join(number, "no").join(index, "block").repartition("block", "qb")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score string")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.col("score").cast("decimal(38,0)")), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    within = F.greatest(F.lit(LONG[0]).cast("decimal(38,0)"), F.least(F.lit(LONG[1]).cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")))
    return ranked.select("query_id", "rank", "vec_id", within.cast("long").alias("score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the highest scores for every vector whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
