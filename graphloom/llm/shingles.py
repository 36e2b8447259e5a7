"""Groups of near copies by the exact Jaccard similarity of word shingles: SimHash, prefix filter, check, connected components."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, release, slices, stage, text_or_empty
from .simhash import fingerprint, link_fingerprints

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BLOCK = 256
#: Bits of the sketch of a set.
SKETCH = 1024
#: Shingles that many texts hold come last in the order of the prefixes. They are told by counts in one text of
#: ORDER_BY, of which the HEAVIEST most frequent count: that only saves work, any order finds the same links.
ORDER_BY, OFTEN, HEAVIEST = 16, 8, 200_000


_rng = np.random.default_rng(SEED)
#: A random number for each byte; an odd base, its inverse modulo 2**64, and their powers as far as texts needed them.
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        room = np.full(max(n, 1 << 16), (BASE, INVERSE)[which], np.uint64)
        room[0] = 1
        _powers[which] = np.multiply.accumulate(room)
    return _powers[which][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z in lower case; words lie between ASCII white space.

    A word's hash is the polynomial of its bytes' numbers, from a running sum over the whole text, mixed.
    """
    raw = np.frombuffer(text.encode("utf-8").lower(), np.uint8)
    white = WHITE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * _power(0, len(raw)), out=sums[1:])
    return _mixed((sums[stops] - sums[starts]) * _power(1, len(raw) + 1)[starts])


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, sorted; of all its words where they are fewer."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mixed(out * BASE + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def prefix(have: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the common order; sets at `similarity` or more share one of them. `often` is sorted.

    The set is looked up in `often` by halving: what a text costs must not grow with how many shingles are frequent.
    """
    hit = often[np.minimum(np.searchsorted(often, have), len(often) - 1)] == have if len(often) else np.zeros(len(have), bool)
    return np.concatenate([have[~hit], have[hit]])[: len(have) - math.ceil(similarity * len(have) - 1e-9) + 1]


def _frequent(words: int):
    def run(batches):
        release()
        for b in slices(batches):
            n = Counter()
            for t in b.column("text").to_pylist():
                n.update(shingles(t, words).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])

    return run


def class_of(have: np.ndarray) -> int:
    """A signed 64-bit digest that stands for a set of shingles."""
    return int.from_bytes(hashlib.md5(have.tobytes()).digest()[:8], "little", signed=True)


def sketch(have: np.ndarray) -> bytes:
    """Whether an odd number of the set's shingles falls on each bit."""
    return np.packbits((np.bincount((have % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with sketches x and y (rows of 64-bit words) and m and n shingles can be at `similarity` or more.

    A shingle that one of two sets lacks turns one bit, so they differ in at least as many shingles as their sketches in bits.
    """
    apart = np.maximum(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), abs(m - n))
    both = (m + n - apart) / 2
    return both >= similarity * (m + n - both) - 1e-9


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH // 64)


def _classes(words: int):
    def run(batches):
        release()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            sets = [shingles(t, words) for t in texts]
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            cols = [b.column("hash"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["hash", "cid", "size", "fp", "sketch"])

    return run


def _prefixes(words: int, similarity: float, shared):
    def run(batches):
        release()
        for b in slices(batches):
            done = {}
            for t in b.column("text").to_pylist():
                have = shingles(t, words)
                if (cid := class_of(have)) not in done:
                    done[cid] = prefix(have, shared.value, similarity).view(np.int64)
            keys = np.concatenate(list(done.values()))
            cids = np.repeat(np.array(list(done), np.int64), [len(k) for k in done.values()])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cids)], names=["key", "cid"])

    return run


def _packed(batches):
    """Texts are smaller than their shingles: those are made anew where they are compared."""
    press = zstandard.ZstdCompressor(level=1)
    for b in slices(batches):
        raw = [press.compress(t.encode("utf-8")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(raw, pa.binary())], names=["cid", "packed"])


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _alike(words: int, similarity: float):
    def run(batches):
        release()
        for b in slices(batches, 64):
            ok, made = [], {}
            for z in {*b.column("x").to_pylist(), *b.column("y").to_pylist()}:
                made[z] = shingles(zstandard.decompress(z).decode("utf-8"), words)
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                ok.append(_similar(made[x], made[y], similarity))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _maybe(similarity: float):
    """The pairs whose sketches and sizes allow the similarity."""

    def run(batches):
        for b in batches:
            m, n = b.column("m").to_numpy(), b.column("n").to_numpy()
            ok = may_link(_sketches(b.column("x")), _sketches(b.column("y")), m, n, similarity)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _starts(t: pa.Table) -> np.ndarray:
    """Where the blocks (key, bi, bj) of a sorted table start."""
    of = [t.column(c).to_numpy() for c in ("key", "bi", "bj")]
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in of])]))


def _blocks(batches, rows: int = 2048):
    """Tables of whole blocks, some `rows` rows each; rows come sorted by (key, bi, bj)."""
    left = None
    for b in slices(batches, rows):
        t = pa.Table.from_batches([b])
        left = t if left is None else pa.concat_tables([left, t])
        if last := int(_starts(left)[-1]):
            yield left.slice(0, last).combine_chunks()
            left = left.slice(last)
    if left is not None and len(left):
        yield left.combine_chunks()


def _candidates(t: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs within blocks that may be linked and have different roots, likeliest by their sketches first; each row's block."""
    bi, bj, own, cid, size, root = (t.column(c).to_numpy() for c in ("bi", "bj", "_b", "cid", "size", "root"))
    sk, starts = _sketches(t.column("sketch").combine_chunks()), _starts(t)
    lengths = np.diff(np.append(starts, len(t)))
    stop, at, out = np.repeat(starts + lengths, lengths), np.arange(len(t)), [np.zeros((2, 0), np.int64)]
    for shift in range(1, len(t)):
        if not len(at := at[at + shift < stop[at]]):
            break
        to = at + shift
        i = at[(root[at] != root[to]) & ((bi[at] == bj[at]) | (own[at] != own[to])) & (np.minimum(size[at], size[to]) >= np.maximum(size[at], size[to]) * similarity - 1e-9)]
        i = i[may_link(sk[i], sk[i + shift], size[i], size[i + shift], similarity)]
        out.append(np.stack([i, i + shift]))
    i, j = np.concatenate(out, axis=1)
    apart = np.bitwise_count(sk[i] ^ sk[j]).sum(axis=1, dtype=np.int64) / (size[i] + size[j])
    order = np.lexsort((np.maximum(cid[i], cid[j]), np.minimum(cid[i], cid[j]), apart))
    return i[order], j[order], np.repeat(np.arange(len(starts)), lengths)


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, linked) -> list[int]:
    """Which of the pairs (i, j), in this order, are linked and join roots that those before do not."""
    up, out = {}, []

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for k, (a, b, x, y) in enumerate(zip(i.tolist(), j.tolist(), root[i].tolist(), root[j].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y and linked(a, b):
            up[y] = x
            out.append(k)
    return out


def _pairs(cid: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct (a, b) with a < b of the ids at these places."""
    return np.unique(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])]), axis=1)


def _likely(similarity: float):
    """Of the blocks' pairs that may be linked, those that would join their roots: fewer than there are members."""

    def run(batches):
        release()
        for t in _blocks(batches):
            i, j, _ = _candidates(t, similarity)
            some = _forest(t.column("root").to_numpy(), i, j, lambda a, b: True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(t.column("cid").to_numpy(), i[some], j[some])], names=["a", "b"])

    return run


UNDECIDED = "a long, b long, key long, bi long, bj long, _b long, cid long, size long, root long, sketch binary"


def _undecided(similarity: float):
    """A block's pairs (a, b) that may still be linked; where they are more than its members, the members' rows instead."""

    def run(batches):
        release()
        for t in _blocks(batches):
            i, j, block = _candidates(t, similarity)
            members = np.unique(np.concatenate([i, j]))
            few = np.bincount(block[i], minlength=block[-1] + 1) <= np.bincount(block[members], minlength=block[-1] + 1)
            a, b = _pairs(t.column("cid").to_numpy(), i[few[block[i]]], j[few[block[i]]])
            rows = t.take(pa.array(members[~few[block[members]]])).combine_chunks()
            nulls = [pa.nulls(len(a), f.type) for f in t.schema]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *nulls], names=["a", "b", *t.schema.names])
            for r in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.int64())] * 2 + r.columns, names=["a", "b", *t.schema.names])

    return run


def _decided(words: int, similarity: float):
    """Links that join the blocks' roots: all pairs that may be linked are compared until they are one."""

    def run(batches):
        release()
        for t in _blocks(batches, 256):
            i, j, _ = _candidates(t, similarity)
            cid, packed, made = t.column("cid").to_numpy(), t.column("packed"), {}

            def of(k):
                if (c := cid[k]) not in made:  # noqa: B023
                    made[c] = shingles(zstandard.decompress(packed[k].as_py()).decode("utf-8"), words)  # noqa: B023
                return made[c]  # noqa: B023

            some = _forest(t.column("root").to_numpy(), i, j, lambda a, b: _similar(of(a), of(b), similarity))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(cid, i[some], j[some])], names=["a", "b"])

    return run


def _different(rows: DataFrame) -> DataFrame:
    """rows of blocks without those of blocks that have the same members on the same sides as another; told by 128 bits."""
    side, key = F.col("_b") == F.col("bi"), ["key", "bi", "bj"]
    told = rows.groupBy(*key).agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("cid", side)).alias("_x"), F.sum(F.xxhash64(F.lit(SEED), side, "cid").cast("decimal(38,0)")).alias("_s")
    )
    first = told.groupBy("_n", "_x", "_s").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    return rows.join(first, key, "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at `similarity` or more."""
    x = sets.select(F.col("cid").alias("a"), F.col("packed").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("packed").alias("y"))
    return stage(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_alike(words, similarity), "a long, b long"), "alike")


def _by_simhash(classes: DataFrame) -> DataFrame:
    """(a, b) of classes whose fingerprints are linked: equal ones, or those that SimHash's lists join."""
    first = classes.groupBy("fp").agg(F.min("cid").alias("c"))
    equal = classes.join(first, "fp").where("cid <> c").select(F.col("c").alias("a"), F.col("cid").alias("b"))
    x, y = first.select(F.col("fp").alias("a"), F.col("c").alias("x")), first.select(F.col("fp").alias("b"), F.col("c").alias("y"))
    near = link_fingerprints(first.select("fp")).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near)


def _joined(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once the links(a, b) are there, too."""
    return connected_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _dealt(lists: DataFrame, joined: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists with several roots as pairs of blocks (bi, bj): key, bi, bj, own block, cid, size, root, sketch, sorted within partitions."""
    flat = lists.select("key", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    open_ = flat.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 and n > 2")
    rows = flat.join(open_.select("key", "n"), "key").join(classes.select("cid", "size", "sketch"), "cid").withColumn("_nb", F.ceil(F.col("n") / BLOCK).cast("long"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("cid"), F.col("_nb"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    rows = rows.select("key", F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), "_b", "cid", "size", "root", "sketch")
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """hash (MD5 of the text), root of every distinct text of docs(text): texts with one root are linked to each other.

    Links are texts with a Jaccard similarity of `similarity` or more over their distinct shingles; null text is empty,
    and texts without words are one class. Texts with equal shingles are one class, too. Linked sets share one of the
    first (1 - similarity) of their shingles in a common order, so lists keyed by those hold all links. Texts that SimHash
    joins are compared first, and members of a list with its first; then only members that this has not joined, with each
    other, in blocks: first the likeliest pairs that would join a block's roots, then all that are left, within a task
    that holds the block's texts, so that no more rows are made than members. Sketches tell most pairs apart before texts are fetched.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty().alias("text")).withColumn("hash", F.md5(F.col("text").cast("binary")))
    some = texts.where(F.pmod(F.xxhash64("hash"), F.lit(ORDER_BY)) == 0).select("text")
    often = some.mapInArrow(_frequent(words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    often = np.sort(np.array([r["key"] for r in often.orderBy(F.desc("n"), "key").limit(HEAVIEST).collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(often)
    told = stage(texts.select("hash", "text").mapInArrow(_classes(words), "hash string, cid long, size long, fp long, sketch binary"), "told")
    classes = told.groupBy("cid").agg(F.min(F.struct("hash", "size", "fp", "sketch")).alias("c"))
    classes = stage(classes.select("cid", "c.*"), "classes")

    flat = texts.select("text").mapInArrow(_prefixes(words, similarity, shared), "key long, cid long")
    by = Window.partitionBy("key")
    flat = flat.withColumn("low", F.min("cid").over(by)).withColumn("high", F.max("cid").over(by)).where("low < high").drop("high")
    flat = stage(flat.distinct(), "lists")
    first = flat.where("cid <> low").select(F.col("low").alias("a"), F.col("cid").alias("b")).unionByName(_by_simhash(classes)).distinct()
    x = classes.select(F.col("cid").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    y = classes.select(F.col("cid").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))
    first = stage(first.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_maybe(similarity), "a long, b long"), "first")

    wanted = flat.select("cid").unionByName(first.select(F.explode(F.array("a", "b")).alias("cid"))).distinct()
    wanted = texts.dropDuplicates(["hash"]).join(classes.select("cid", "hash").join(wanted, "cid"), "hash").select("cid", "text")
    sets = stage(wanted.mapInArrow(_packed, "cid long, packed binary"), "packed")

    joined = connected_components(_linked(first, sets, words, similarity))
    likely = _dealt(flat, joined, classes).mapInArrow(_likely(similarity), "a long, b long").distinct()
    joined = _joined(joined, _linked(stage(likely, "pairs"), sets, words, similarity))
    left = stage(_dealt(flat, joined, classes).mapInArrow(_undecided(similarity), UNDECIDED), "undecided")
    many = _different(left.where("key is not null").drop("a", "b")).join(sets, "cid").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    links = stage(many.mapInArrow(_decided(words, similarity), "a long, b long"), "decided")
    joined = _joined(joined, links.unionByName(_linked(left.where("a is not null").select("a", "b").distinct(), sets, words, similarity)))
    rooted = classes.select("cid").join(joined, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"))
    return told.select("hash", "cid").distinct().join(rooted, "cid").select("hash", "root")
