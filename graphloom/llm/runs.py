"""Periodic runs of words: aligned blocks found again at distances of their scale, extended to maximal stretches."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, text_or_empty

LEAST = 12
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """How far on the same id stands next; a distance beyond the text if nowhere."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), 4 * len(ids) + 4, np.int64)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def _agreeing(ids: np.ndarray, i: int, j: int) -> int:
    """How many ids from i on equal those from j on, j > i."""
    at, width, n = 0, 32, len(ids) - j
    while at < n:
        width = min(width, n - at)
        differ = ids[i + at : i + at + width] != ids[j + at : j + at + width]
        if differ.any():
            return at + int(differ.argmax())
        at, width = at + width, width * 2
    return n


def _seeds(ids: np.ndarray, block: int, keys: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of blocks `keys` (numbers of aligned blocks) that stand again first to last words further on.

    The automaton's keys are the blocks' id sequences; it reads only the windows that some block's distances reach.
    """
    n, named = len(ids), np.full(len(ids) // block, -1, np.int64)
    auto, names = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for b in keys.tolist():
        key = tuple(ids[b * block : b * block + block].tolist())
        if (name := names.get(key)) is None:
            name = names[key] = len(names)
            auto.add_word(key, name)
        named[b] = name
    auto.make_automaton()
    low, high = keys * block + first, np.minimum(keys * block + last + block, n)
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    found: list[np.ndarray] = []
    for s, e in zip(low[np.concatenate([[0], cut])].tolist(), high[np.concatenate([cut - 1, [len(keys) - 1]])].tolist(), strict=True):
        for part in range(s, e, 1 << 16):  # windows of a bounded number of words; neighbours overlap by a block less one
            stop = min(part + (1 << 16) + block - 1, e)
            hits = np.array(list(auto.iter(tuple(ids[part:stop].tolist()))), np.int64).reshape(-1, 2)
            found.append(hits + [part - block + 1, 0])
    hits = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    starts, ways = [], []
    for back in range((last - first) // block + 2):  # the aligned blocks that lie first to last words before a hit
        b = (hits[:, 0] - first) // block - back
        ok = (b >= 0) & (hits[:, 0] - b * block <= last)
        ok[ok] = named[b[ok]] == hits[ok, 1]
        starts.append(b[ok] * block)
        ways.append(hits[ok, 0] - b[ok] * block)
    return np.concatenate(starts), np.concatenate(ways)


def _extend(ids, block: int, a: np.ndarray, d: np.ndarray, known: np.ndarray, held: np.ndarray, least: int, found: dict) -> None:
    """Puts the maximal stretch of each seed into found, if it is long enough, with its smallest period so far.

    Where both copies lie in known runs of a short period, they agree as far as both runs go, and no further unless both
    end there: so one run costs no second reading.
    """
    n, back = len(ids), ids[::-1]
    one, two = known[held[a]], known[held[a + d]]
    new = (held[a] < 0) | (held[a] != held[a + d]) | (d % one[:, 2] != 0)
    inside = (held[a] >= 0) & (held[a + d] >= 0)
    left = np.where(inside, np.minimum(a - one[:, 0], a + d - two[:, 0]), 0)
    right = np.where(inside, np.minimum(one[:, 1] - a, two[:, 1] - a - d), block)
    closed = inside & (a - one[:, 0] != a + d - two[:, 0]) & (one[:, 1] - a != two[:, 1] - a - d)
    new &= ~closed | (left + right + d >= np.maximum(least, 2 * d))
    order = np.flatnonzero(new)
    order = order[np.lexsort((a[order], d[order]))]
    done, at = -1, 0
    for a1, d1, l1, r1 in zip(a[order].tolist(), d[order].tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        if d1 != done:
            done, at = d1, 0
        if a1 + d1 + block <= at:
            continue
        at = a1 + d1 + r1 + _agreeing(ids, a1 + r1, a1 + d1 + r1)
        start = a1 - l1 - _agreeing(back, n - a1 - d1 + l1, n - a1 + l1)
        if at - start >= max(least, 2 * d1):
            found[start, at] = min(d1, found.get((start, at), d1))


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with smallest period q and length >= max(least, 2 * q), sorted.

    A stretch of period q holds, in the part whose copy q further on is in it too, an aligned block of B words for the
    largest power of two with 2 * B - 1 <= q (smaller q: 2 * B - 1 <= least / 2), so that q is at most 4 * B - 2. Each such
    block is searched at those distances; a hit is extended both ways to the maximal stretch of that period. A block
    counts only if each of its words comes again within 4 * B - 2 words, and not where a known run with a period of at
    most B / 2 holds all it can find: there it recurs at multiples of that period only, which give the same stretch.
    """
    n, found = len(ids), {}
    block = 1
    while 4 * block - 1 <= -(-least // 2):
        block *= 2
    first, far = 1, _next_distance(ids) if n else np.empty(0, np.int64)
    reach = far[: n // block * block].reshape(-1, block).max(axis=1) if n >= block else far[:0]
    while len(reach) and 2 * first <= n:
        last = min(4 * block - 2, n)
        known = np.array([(s, e, q) for (s, e), q in found.items() if 2 * q <= block <= e - s], np.int64).reshape(-1, 3)
        known = np.concatenate([known, [[0, 0, 1]]])
        held = np.full(n - block + 1, -1, np.int32)  # the known run that holds the block words from here on; there is one at most
        for i, (s, e, _) in enumerate(known[:-1].tolist()):
            held[s : e - block + 1] = i
        keys = np.flatnonzero(reach <= last)
        keys = keys[known[held[keys * block], 1] < np.minimum(keys * block + last + block, n)]
        if len(keys):
            _extend(ids, block, *_seeds(ids, block, keys, first, last), known, held, least, found)
        first, block = 4 * block - 1, block * 2
        reach = np.maximum(reach[0 : len(reach) // 2 * 2 : 2], reach[1::2])
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _per_text(least: int):
    def run(batches):
        release()
        for b in slices(batches, 64):
            runs, kept = [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = text.split()
                names = {w: i for i, w in enumerate(dict.fromkeys(words))}
                found = find_runs(np.fromiter(map(names.__getitem__, words), np.int64, len(words)), least)
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                edge = np.zeros(len(words) + 1, np.int64)
                for s, k, q in found:
                    edge[s + q] += 1
                    edge[s + k] -= 1
                kept.append(b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()) if found else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, TYPE), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), collapsed, for every row of docs(doc_id, text).

    `collapsed` is the text's words joined by one space, without those that a run holds after its first period. Null and
    empty texts have no runs and an empty `collapsed`; null and repeated doc_ids are rows of their own; other columns are
    ignored; an empty table gives no row. A text is one row of one task: no shuffle, memory bounded by the longest text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_per_text(least), f"doc_id long, runs {RUNS}, collapsed string")


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one text in ten (by the id's crc32) repeats a stretch of its words to its end.

    With h the crc32 of the decimal id, g = floor(h / 10) and n words: if h % 10 = 0, word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id or a text without words stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.filter(F.split("text", SPACE), lambda x: x != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    turned = rows.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("n", F.size("w").cast("long"))
    turned = turned.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    turned = turned.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    picked = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return turned.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    length, period = -F.col("best.less"), F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr('1000 * -best.less div best.period').cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of `documents`, the cycles of `with_cycles` in it; rows as in `periodic_runs`."""
    return digest(periodic_runs(with_cycles(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
