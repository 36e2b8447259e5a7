"""SimHash near-duplicates: fingerprints of word shingles, pigeonring filter, connected components."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, release, slices, stage, text_or_empty

BITS, SEGMENTS, WIDTH, BUDGET = 64, 4, 16, 3
BLOCK = 256


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the shingles' XXH64 (seed 42). No words: 0."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    it = zip(*[w[i:] for i in range(words)], strict=False) if len(w) >= words else iter([tuple(w)])
    ones, n = np.zeros(BITS, np.int64), 0
    while hs := [digest(join(t), 42) for t in islice(it, 65536)]:
        bits = np.unpackbits(np.array(hs, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(hs)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        release()
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed) of every whole text of docs(doc_id, text); null text is empty and has fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def ring_ok(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether differences x make a viable chain from segment `start`: each prefix of l segments within l * 3 / 4."""
    turn = (start * WIDTH).astype(np.uint64)
    x = (x >> turn) | (x << ((np.uint64(BITS) - turn) % np.uint64(BITS)))
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for part in range(SEGMENTS):
        total += np.bitwise_count((x >> np.uint64(part * WIDTH)) & np.uint64((1 << WIDTH) - 1))
        ok &= total <= (part + 1) * BUDGET // SEGMENTS
    return ok


def _star(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges (member, root) that join what links connect among a few fingerprints of one list."""
    n, label = len(fp), np.full(len(fp), -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front = i, np.array([i])
        while len(front):
            free = np.flatnonzero(label < 0)
            if not len(free):
                break
            x = (fp[front][:, None] ^ fp[free][None, :]).ravel()
            hit = ring_ok(x, np.full(len(x), start)).reshape(len(front), len(free)).any(axis=0)
            front = free[hit]
            label[front] = i
    s = fp.view(np.int64)
    return [(int(s[i]), int(s[label[i]])) for i in range(n) if label[i] != i]


def _linked(batches):
    """Rows come sorted by (key, bi, bj); small lists are compared by shifts over all rows, larger ones one by one."""
    left = None
    for b in batches:
        t = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "bi", "bj", "fp")])
        left = t if left is None else np.concatenate([left, t], axis=1)
        same = (left[:3] == left[:3, -1:]).all(axis=0)
        stop = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if stop:
            yield from _edges(left[:, :stop])
            left = left[:, stop:]
    if left is not None and left.shape[1]:
        yield from _edges(left)


def _edges(t: np.ndarray):
    head = np.flatnonzero(np.concatenate([[True], (t[:3, 1:] != t[:3, :-1]).any(axis=0)]))
    size = np.diff(np.concatenate([head, [t.shape[1]]]))
    fp, start = t[3].view(np.uint64), (t[0] >> 25).astype(np.int64)
    pairs: list[tuple[int, int]] = []
    small = np.repeat(size, size) <= 8
    pos = np.arange(t.shape[1]) - np.repeat(head, size)
    room = np.repeat(size, size) - pos
    for shift in range(1, 8):
        i = np.flatnonzero(small & (room > shift))
        if not len(i):
            break
        x = fp[i] ^ fp[i + shift]
        i = i[(x != 0) & ring_ok(x, start[i])]
        pairs += zip(t[3][i].tolist(), t[3][i + shift].tolist(), strict=True)
    for h, n in zip(head[size > 8], size[size > 8], strict=True):
        pairs += _star(np.ascontiguousarray(fp[h : h + n]), int(start[h]))
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _keys(fp: Column) -> Column:
    """24-bit list keys: for each start, its segment, and one half of the next, which differs in at most one bit."""
    keys = []
    for i in range(SEGMENTS):
        seg = F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit(0xFFFF))
        nxt = F.shiftrightunsigned(fp, (i + 1) % SEGMENTS * WIDTH).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftrightunsigned(nxt, half * 8).bitwiseAND(F.lit(0xFF))
            keys.append(F.lit((i * 2 + half) << 24) + seg * 256 + part)
    return F.array(*keys)


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` such that links (3 bits or fewer) connect the same ones as all links do.

    Two fingerprints within 3 bits have, by the pigeonring principle, a start among 4 segments on a ring from which
    every prefix of l segments differs in at most l * 3 / 4 bits: none in the first, one in the first two. Lists are
    keyed by that first segment and an unchanged half of the next. Chains prune before the full distance. Long lists
    are dealt as pairs of blocks, and a block gives a spanning star, never all its pairs.
    """
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key").withColumn("_nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rows = rows.select(
        F.col("key").cast("long").alias("key"), F.least("_b", "_o").cast("long").alias("bi"),
        F.greatest("_b", "_o").cast("long").alias("bj"), "fp",
    )
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return rows.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, itself included. Null text counts as empty; empty texts have
    fingerprint 0 and link like any other; null doc_ids get a component but never name one unless alone (null);
    repeated rows are kept; other columns are ignored; an empty table gives no row.
    """
    fps = stage(fingerprints(docs, words), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "classes")
    links = connected_components(link_fingerprints(classes))
    rooted = classes.join(links, classes["fp"] == links["node"], "left")
    rooted = stage(rooted.select("fp", "doc", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
