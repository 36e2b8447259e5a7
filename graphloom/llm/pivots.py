"""Near-duplicate vectors by a pivot-permutation index: ordered nearest pivots, inverted lists, shared pivots, check."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, stage

THRESHOLD = 0.95
#: Pivots follow the root of the number of distinct vectors between these bounds: lists then keep their length. They are
#: chosen among POOL times as many vectors (at most MOST_READ) with the smallest hashes, which are read to fit the index.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 4_096
POOL, MOST_READ = 4, 8_192
#: Pivots are apart: none has a cosine above the first of these with another. The next ones count only while there are
#: fewer than FEWEST_PIVOTS.
APART = (0.5, 0.6, 0.7, 0.8)
NEAREST, SHARED = 7, 3
BLOCK = 1024
#: rows of a block pair that are looked at together
ROWS = 256


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """cid, embedding, n, vec_id (smallest): one row for each distinct vector that can link."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(fine)
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # no negative zeros
    classes = rows.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    return stage(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")


def _unit(lists: list, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest pivots by cosine, nearest first, ties to the smaller index."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :k]


def spread(units: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of the candidates as pivots, in their order, each apart from those before.

    In a group of near copies the pivots that lie inside it are ordered by noise; a hot group would own its share of a
    plain sample, and its links would share too few of their nearest pivots.
    """
    chosen: list[int] = []
    for level in APART:
        if chosen and len(chosen) >= FEWEST_PIVOTS:
            break
        nearest = (units @ units[chosen].T).max(axis=1) if chosen else np.full(len(units), -2.0)
        for i in range(len(units)):
            if len(chosen) == count:
                break
            if nearest[i] <= level:
                chosen.append(i)
                nearest = np.maximum(nearest, units @ units[i])
    return units[chosen]


def _posted(pivots: np.ndarray, near: int, shared: int):
    dims = pivots.shape[1]
    subsets = np.array(list(combinations(range(near), shared)))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                units = _unit(some.column("embedding").to_pylist(), dims)
                lists = np.sort(nearest_pivots(units, pivots, near), axis=1).astype(np.int64)
                key = np.zeros((len(lists), len(subsets)), np.int64)
                for j in range(shared):
                    key = key * MOST_PIVOTS + lists[:, subsets[:, j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("cid"), some.column("n"),
                        pa.array([u.tobytes() for u in units], pa.binary()), pa.array([x.astype(np.int16).tobytes() for x in lists], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * key.shape[1], pa.int32()), pa.array(key.ravel())),
                    ],
                    names=["cid", "n", "unit", "near", "keys"],
                )

    return run


def _checked(threshold: float, shared: int):
    """Members of each list (or pair of its blocks), compared by cosine; rows come sorted by (key, bi, bj)."""

    def group(key: int, bi: int, bj: int, cid, n, block, units, near):
        hit = units @ units.T >= threshold
        np.fill_diagonal(hit, False)
        if bi != bj:
            hit &= block[:, None] != block[None, :]
        if not hit.any():
            return None
        root, parts = np.arange(len(cid)), [slice(at, at + ROWS) for at in range(0, len(cid), ROWS)]
        for _ in range(len(cid)):  # the smallest member that links reach
            low = np.minimum(root, np.concatenate([np.where(hit[p], root[None, :], len(cid)).min(axis=1) for p in parts]))
            if (low == root).all():
                break
            root = low[low]
        last = key % MOST_PIVOTS  # a pair counts in the first list that both are in: no other shared pivot up to its last
        few = np.unique(near[near <= last])
        row, at = np.nonzero(near <= last)
        held = np.zeros((len(cid), len(few)), np.float32)
        held[row, np.searchsorted(few, near[row, at])] = 1
        links = np.concatenate([(hit[p] & (held[p] @ held.T == shared)) @ n for p in parts])
        some = np.flatnonzero(hit.any(axis=1))
        return cid[some], cid[root[some]], links[some]

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            left = t if left is None else pa.concat_tables([left, t])
            k = np.stack([left.column(c).to_numpy() for c in ("key", "bi", "bj")])
            heads = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)])) if k.shape[1] else np.array([0])
            yield from spans(left, k, heads[:-1], heads[1:])
            left = left.slice(int(heads[-1]))
        if left is not None and left.num_rows:
            k = np.stack([left.column(c).to_numpy() for c in ("key", "bi", "bj")])
            yield from spans(left, k, np.array([0]), np.array([left.num_rows]))

    def spans(t: pa.Table, k: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        out = []
        cid, n, block = (t.column(c).to_numpy() for c in ("cid", "n", "block"))
        units, near = t.column("unit").to_pylist(), t.column("near").to_pylist()
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            if e - s < 2:
                continue
            u = np.frombuffer(b"".join(units[s:e])).reshape(e - s, -1)
            v = np.frombuffer(b"".join(near[s:e]), np.int16).reshape(e - s, -1).astype(np.int64)
            if (found := group(int(k[0, s]), int(k[1, s]), int(k[2, s]), cid[s:e], n[s:e], block[s:e], u, v)) is not None:
                out.append(found)
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["cid", "root", "links"])

    return run


def near_links(classes: DataFrame, threshold: float = THRESHOLD, near: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(cid, root, links) partial results: rows of linked vectors in a list with one that links reach, and link counts.

    Two vectors share `shared` of their `near` nearest pivots if and only if they meet in the inverted list of some
    `shared` pivots. Lists with one member go before vectors are moved; long lists are dealt as pairs of blocks, each a
    matrix product in double precision; a pair's links are counted in one list only, so no pairs leave a task.
    """
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    count = min(MOST_PIVOTS, max(FEWEST_PIVOTS, 1 << int(np.ceil(np.log2(max(1, n) ** 0.5)))))
    if n < 2:
        return classes.select("cid", F.col("cid").alias("root"), F.lit(0).cast("long").alias("links")).limit(0)
    picked = classes.orderBy(F.xxhash64("embedding"), "cid").limit(min(POOL * count, MOST_READ)).select("embedding").collect()
    pivots = spread(_unit([r[0] for r in picked], dims), count)
    near = min(near, len(pivots))
    shared = min(shared, near)
    posted = "cid long, n long, unit binary, near binary, keys array<long>"
    posts = stage(classes.select("cid", "n", "embedding").mapInArrow(_posted(pivots, near, shared), posted), "posts")
    flat = posts.select("cid", F.explode("keys").alias("key"))
    sizes = flat.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = flat.join(sizes, "key").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("long"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
    rows = rows.select("cid", "key", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    rows = rows.join(posts.select("cid", "n", "unit", "near"), "cid")
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cid")
    return rows.select("key", "bi", "bj", "cid", "n", "block", "unit", "near").mapInArrow(_checked(threshold, shared), "cid long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding).

    Equal vectors are one class that links with itself; links between classes are found by the index (measured recall
    is in the README) and checked exactly. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; missing components of shorter vectors are 0; a null vec_id never names a component unless all
    its members have none; repeated rows are kept; other columns are ignored; an empty table gives no row.
    """
    classes = distinct_vectors(vectors)
    found = stage(near_links(classes, threshold), "links")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.join(links, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
    told = stage(told.select("embedding", "vec_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "told")
    named = told.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    told = told.join(named, "root").select(F.col("embedding").alias("_e"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("_v"))
    rows = rows.join(told, F.col("_v") == F.col("_e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
