"""Repeated strings of bytes across documents, by longest-previous-factor arrays over the places that can repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, stage, text_or_empty

LENGTH, GRAM = 200, 64
PIECE = 1 << 20
#: starts of strings in one suffix order; contexts of one anchor beyond which it is dealt by hashes; strings of one block there
STARTS, LIMIT, BLOCK = 100_000, 512, 12
_TABLE = np.random.default_rng(12).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
SEGMENT = "ha long, hc long, doc_key long, t long, at long, len int, times int"
CONTEXT = "ha long, hc long, doc_key long, t long, at long, len int, d long, ctx binary"
MARK = "doc_key long, t long, s long, e long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of GRAM bytes, by doubling."""
    h = _TABLE[data]
    for i, step in enumerate(_STEPS):
        h = h[: -(1 << i)] * step + (h[1 << i :] ^ (h[1 << i :] >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    h *= _STEPS[0]
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, count, anchor, hash): runs of starts of strings of `length` bytes that share an anchor.

    The anchor of a string is the leftmost of its GRAM-byte pieces with the smallest hash. It depends on the string's
    bytes alone, so equal strings have equal anchors in the same place. Texts longer than PIECE are cut in runs, no more.
    """
    out = []
    for base in range(0, max(len(data) - length + 1, 0), PIECE - length + 1):
        h = gram_hashes(data[base : base + PIECE])
        least = (h & np.uint64(~(PIECE - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor = (least & np.uint64(PIECE - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        out.append((start + base, np.diff(start, append=len(anchor)), anchor[start] + base, h[anchor[start]].view(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.empty((4, 0), np.int64))


def _text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _segmented(length: int):
    def run(batches):
        release()
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, 64):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for key, text in zip(b.column("doc_key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if len(text) < length:
                    continue
                at, count, _, ha = segments(np.frombuffer(text, np.uint8), length)
                hc = np.array([digest(text[s : s + k]) for s, k in zip(at.tolist(), (count + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                new = np.concatenate([[True], (hc[1:] != hc[:-1]) | (ha[1:] != ha[:-1]) | (count[1:] != count[:-1])])
                head = np.flatnonzero(new)  # equal neighbours (periodic text) are one row
                n = len(head)
                for c, x in zip(cols, (ha[head], hc[head], np.full(n, key), np.full(n, _text_hash(text)), at[head], count[head], np.diff(head, append=len(at))), strict=True):
                    c.append(x)
            if cols[0]:
                ha, hc, key, t, at, count, times = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ha, hc, key, t, at)] + [pa.array(x.astype(np.int32)) for x in (count, times)], names=["ha", "hc", "doc_key", "t", "at", "len", "times"])

    return run


def _packed(batches):
    """Whole texts, compressed while they travel."""
    release()
    press = zstandard.ZstdCompressor(level=1)
    for b in slices(batches, 256):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        t = pa.array(map(_text_hash, texts), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc_key"), t, pa.array(map(press.compress, texts), pa.binary())], names=["doc_id", "doc_key", "t", "z"])


def _contexts(length: int):
    def run(batches):
        release()
        for b in slices(batches, 64):
            out: list[tuple] = []
            for row in b.to_pylist():
                text = zstandard.decompress(row["z"])
                out += [(w["ha"], w["hc"], row["doc_key"], row["t"], w["at"], w["len"], w["d"], text[w["at"] : w["at"] + w["len"] + length - 1]) for w in row["wanted"]]
            if out:
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["ha", "hc", "doc_key", "t", "at", "len", "d", "ctx"])

    return run


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry in suffix order, what it has in common with the nearest entry before it that stands earlier in the text.

    Pointers jump over entries that stand later; the common length is the least of those jumped over.
    """
    n = len(place)
    to, common = np.arange(-1, n - 1), np.concatenate([[0], lcp])
    open_ = np.arange(1, n)
    while len(open_):
        open_ = open_[place[to[open_]] > place[open_]]
        jump = to[open_]
        common[open_], to[open_] = np.minimum(common[open_], common[jump]), to[jump]
        gone = to[open_] < 0
        common[open_[gone]] = 0
        open_ = open_[~gone]
    return common


def longest_factors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor), at most `length`, of the suffixes of data at ascending `starts`.

    Suffixes are sorted by their first `length` bytes. The neighbours of a suffix in that order that stand earlier in
    the text, the previous and the next smaller position, give the longest factor that occurs before; those that stand
    later give the longest one that occurs after.
    """
    text = np.ascontiguousarray(sliding_window_view(data, length)[starts])
    order = np.argsort(text.view(f"S{length}").ravel(), kind="stable")
    text = text[order]
    same = text[1:] == text[:-1]
    lcp = np.where(same.all(axis=1), length, same.argmin(axis=1))
    previous, following = (np.maximum(_nearest_smaller(x, lcp), _nearest_smaller(x[::-1], lcp[::-1])[::-1]) for x in (order, -order))
    out = np.empty((2, len(starts)), np.int64)
    out[:, order] = previous, following
    return out[0], out[1]


def _marks(keys: np.ndarray, t: np.ndarray, place: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Runs of hit starts: place is the start's position in its document, rows of one context stand together."""
    i = np.flatnonzero(hit)
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(place[i]) != 1) | (np.diff(keys[i]) != 0) | (t[i[1:]] != t[i[:-1]])]) if len(i) else np.empty(0, bool)
    head = i[new]
    tail = i[np.concatenate([new[1:], [True]])] if len(i) else i
    return pa.RecordBatch.from_arrays([pa.array(keys[head]), pa.array(t[head]), pa.array(place[head]), pa.array(place[tail] + 1)], names=["doc_key", "t", "s", "e"])


def _factors(length: int, first: bool):
    """Contexts come sorted by anchor, then document; those of several anchors share a suffix order."""

    def marks(rows):
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        count = np.array([r[3] for r in rows])
        base = np.cumsum([0, *(len(r[4]) for r in rows[:-1])])
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key, t, at = (np.repeat(np.array([r[i] for r in rows], np.int64), count) for i in range(3))
        before, after = longest_factors(data, np.repeat(base, count) + inner, length)
        return _marks(key, t, at + inner, before >= length if first else np.maximum(before, after) >= length)

    def run(batches):
        release()
        held, size, last = [], 0, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("ha", "doc_key", "t", "at", "len", "ctx")]
            for ha, *row in zip(*cols, strict=True):
                if size >= STARTS and ha != last:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + row[3], ha
        if held:
            yield marks(held)

    return run


def repeated(rows: DataFrame, keys: list[str], whole: str, times: str = "1") -> DataFrame:
    """rows whose keys occur more than once, with `mixed`: whether they differ in `whole`.

    A key's sums are added up before they are shuffled; rows meet them in a join, whose large keys Spark splits.
    """
    found = rows.groupBy(*keys).agg(F.expr(f"sum({times})").alias("_n"), F.min(whole).alias("_a"), F.max(whole).alias("_b")).where("_n > 1")
    return rows.join(found.select(*keys, F.expr("_a < _b").alias("mixed")), keys)


def _halves(data: bytes, seed: int = 0) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data, seed)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _blocks(length: int):
    """Blocks of up to BLOCK neighbouring strings: keyed by what all strings that such a block can hold share."""

    def run(batches):
        for b in slices(batches, 256):
            out = []
            for r in b.select(["ha", "hc", "doc_key", "t", "at", "len", "ctx"]).to_pylist():
                _, _, anchor, _ = segments(np.frombuffer(r["ctx"][:length], np.uint8), length)
                o, last = int(anchor[0]), int(anchor[0]) - r["len"] + 1
                for j in range(last // BLOCK, o // BLOCK + 1):
                    low, high = max(last, j * BLOCK), min(o, j * BLOCK + BLOCK - 1)
                    core = r["ctx"][o - j * BLOCK : o - j * BLOCK + length - BLOCK + 1]
                    whole = xxhash.xxh3_64_intdigest(r["ctx"][o - high : o - low + length], low * length + high) - (1 << 63)
                    out.append((*_halves(core, j), whole, r["ha"], r["hc"], r["doc_key"], r["t"], r["at"] + o - high, r["at"] + o - low + 1))
            names = ["k1", "k2", "whole", "ha", "hc", "doc_key", "t", "s", "e"]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    return run


def _strings(length: int):
    """Each string of the wanted blocks, by hash."""

    def run(batches):
        for b in slices(batches, 256):
            out = []
            for r in b.to_pylist():
                for w in r["wanted"]:
                    out += [(*_halves(r["ctx"][i - r["at"] : i - r["at"] + length]), 0, r["doc_key"], r["t"], i, i + 1) for i in range(w["s"], w["e"])]
            names = ["k1", "k2", "whole", "doc_key", "t", "s", "e"]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    return run


def _later(rows: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """Marks of the rows; without the first row of each key, if that is to stay."""
    if first:
        least = rows.groupBy(*keys).agg(F.min(F.struct("doc_key", "t", "s")).alias("_f"))
        rows = rows.join(least, keys).where(F.struct("doc_key", "t", "s") != F.col("_f"))
    return rows.select("doc_key", "t", "s", "e")


def _hot_marks(hot: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeated strings of anchors with very many contexts, by hashes of 128 bits: blocks of strings first, then strings.

    Equal blocks are marked as such; of each, the first stands for all where blocks that differ share a key.
    """
    blocks = stage(hot.mapInArrow(_blocks(length), "k1 long, k2 long, whole long, ha long, hc long, doc_key long, t long, s long, e long"), "blocks")
    place = F.struct("doc_key", "t", "s", "e", "ha", "hc")
    wholes = stage(blocks.groupBy("k1", "k2", "whole").agg(F.count("*").alias("m"), F.min(place).alias("p")), "wholes")
    alike = _later(blocks.join(wholes.where("m > 1").select("k1", "k2", "whole"), ["k1", "k2", "whole"], "left_semi"), ["k1", "k2", "whole"], first)
    several = wholes.groupBy("k1", "k2").agg(F.count("*").alias("d")).where("d > 1")
    lists = wholes.join(several, ["k1", "k2"]).groupBy("p.ha", "p.hc").agg(F.collect_list(F.struct("p.s", "p.e")).alias("wanted"))
    single = hot.join(lists, ["ha", "hc"]).select("doc_key", "t", "at", "ctx", "wanted")
    single = single.mapInArrow(_strings(length), "k1 long, k2 long, whole long, doc_key long, t long, s long, e long")
    return alike.unionByName(_later(repeated(single, ["k1", "k2"], "whole"), ["k1", "k2"], first))


def _starts(docs: DataFrame, length: int, first: bool) -> DataFrame:
    """(doc_key, t, s, e): runs of starts of repeated strings."""
    found = stage(repeated(docs.mapInArrow(_segmented(length), SEGMENT), ["ha"], "hc", "times"), "segments")
    place = F.struct("doc_key", "t", "at", "len")
    classes = stage(found.groupBy("ha", "hc").agg(F.sum("times").alias("m"), F.min(place).alias("p"), F.first("mixed").alias("mixed")), "classes")
    copies = found.join(classes.where("m > 1").select("ha", "hc", "p"), ["ha", "hc"])
    end = F.expr("at + len * times")
    begin = F.when(F.expr("p.doc_key = doc_key and p.t = t and p.at = at"), F.expr("at + len")).otherwise(F.col("at")) if first else F.col("at")
    copied = copies.select("doc_key", "t", begin.alias("s"), end.alias("e")).where("s < e")
    sizes = classes.where("mixed").groupBy("ha").agg(F.count("*").alias("d")).where("d > 1")
    wanted = classes.where("mixed").join(sizes, "ha").groupBy(F.col("p.doc_key"), F.col("p.t"))
    wanted = wanted.agg(F.collect_list(F.struct("ha", "hc", F.col("p.at"), F.col("p.len"), "d")).alias("wanted"))
    texts = docs.mapInArrow(_packed, "doc_id long, doc_key long, t long, z binary").drop("doc_id").dropDuplicates(["doc_key", "t"])
    contexts = stage(texts.join(wanted, ["doc_key", "t"]).mapInArrow(_contexts(length), CONTEXT), "contexts")
    small = contexts.where(F.col("d") <= LIMIT).repartition("ha").sortWithinPartitions("ha", "doc_key", "t", "at")
    marks = copied.unionByName(small.mapInArrow(_factors(length, first), MARK))
    return marks.unionByName(_hot_marks(contexts.where(F.col("d") > LIMIT), length, first))


def _cut(length: int):
    def run(batches):
        release()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, 64):
            n_bytes, spans, kept = [], [], []
            for z, marks in zip(b.column("z").to_pylist(), b.column("marks").to_pylist(), strict=True):
                text, out, at = zstandard.decompress(z), [], 0
                for m in sorted((m["s"], m["e"] + length - 1) for m in marks or ()):
                    if out and m[0] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], m[1])
                    else:
                        out.append({"start": m[0], "end": m[1]})
                parts = []
                for s in out:
                    parts.append(text[at : s["start"]])
                    at = s["end"]
                n_bytes.append(len(text))
                spans.append(out)
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, end exclusive), kept (the other bytes) of docs(doc_id, text).

    A byte goes if a string of `length` bytes covers it that also starts elsewhere, in the same text or another one;
    with keep_first, only if it starts earlier there (by doc_id, null as 0, then text hash, then position), so that the
    first occurrence stays; rows equal in id and text then share one place and are treated alike. Strings never cross
    texts. Null text is empty; shorter texts keep all; repeated rows are copies of each other; other columns are ignored;
    an empty table gives no row.

    Only starts whose anchor (see `segments`) occurs again can repeat. Equal contexts of an anchor are counted as one, with their
    number; different ones are put in suffix order, anchors apart, and longest-factor arrays tell which strings stand
    earlier or later too. An anchor with more than LIMIT contexts is split by hashes of 128 bits instead.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_key"), text_or_empty().alias("text"))
    marks = _starts(rows.select("doc_id", "doc_key", "text"), length, keep_first)
    marks = marks.groupBy("doc_key", "t").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    texts = rows.mapInArrow(_packed, "doc_id long, doc_key long, t long, z binary")
    kept = texts.join(marks, ["doc_key", "t"], "left").select("doc_id", "z", "marks")
    return kept.mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of `documents` in a string of 200 bytes that also starts elsewhere goes, first occurrences included."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
