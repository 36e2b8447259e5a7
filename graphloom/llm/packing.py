"""Harmonic packing of token ids into sequences of a fixed capacity."""

from __future__ import annotations

from array import array
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .encoders import WordEncoder, encoder

CAPACITY, END_ID = 4096, 2
#: The last class holds all lengths up to capacity / CLASSES.
CLASSES = 64
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Harmonic:
    """One worker's bins. A piece is (doc_id, start, length, doc_tokens, ids); `closed` gets full sequences of pieces.

    Class k holds what is longer than capacity / (k + 1) and at most capacity / k; its bin takes k whole documents.
    What such a bin leaves free waits for a later document, which is cut to close waiting bins as soon as they have
    room for all of it; all others stay whole. Documents above the capacity first give pieces of just that length.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = CLASSES):
        self.capacity, self.most = capacity, min(most, capacity)
        self.open: dict[int, list] = {}
        self.used: dict[int, int] = {}
        self.waiting: deque = deque()  # [pieces, room]
        self.room = 0
        self.closed: list[list[tuple]] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        piece = lambda a, b: (doc_id, a, b - a, n, ids[a * 4 : b * 4])
        while n - at >= self.capacity:
            self.closed.append([piece(at, at + self.capacity)])
            at += self.capacity
        if n - at and n - at <= self.room:
            while at < n:
                bin_ = self.waiting[0]
                take = min(bin_[1], n - at)
                bin_[0].append(piece(at, at + take))
                bin_[1] -= take
                self.room -= take
                at += take
                if not bin_[1]:
                    self.closed.append(self.waiting.popleft()[0])
        elif n - at:
            self.keep(piece(at, n))

    def keep(self, piece: tuple) -> None:
        k = min(self.capacity // piece[2], self.most)
        bin_ = self.open.setdefault(k, [])
        free = self.capacity - self.used.get(k, 0)
        if k == self.most and piece[2] >= free:  # the class of short ones has no fixed count: its bin closes when full
            first, rest = cut(piece, free)
            self.closed.append([*bin_, first])
            self.open[k], self.used[k] = ([rest], rest[2]) if rest else ([], 0)
            return
        bin_.append(piece)
        self.used[k] = self.capacity - free + piece[2]
        if len(bin_) == k < self.most:
            room = self.capacity - self.used[k]
            self.open[k], self.used[k] = [], 0
            if room:
                self.waiting.append([bin_, room])
                self.room += room
            else:
                self.closed.append(bin_)

    def finish(self) -> None:
        """What is left of all classes fills sequences of the capacity; the end goes to sequences of powers of two."""
        left = deque(p for bin_ in [*self.open.values(), *[w[0] for w in self.waiting]] for p in bin_)
        todo = sum(p[2] for p in left)
        while todo:
            size = self.capacity if todo >= self.capacity else 1 << (todo.bit_length() - 1)
            todo -= size
            bin_ = []
            while size:
                first, rest = cut(left.popleft(), size)
                bin_.append(first)
                size -= first[2]
                if rest:
                    left.appendleft(rest)
            self.closed.append(bin_)
        self.open, self.used, self.room = {}, {}, 0
        self.waiting.clear()


def cut(piece: tuple, length: int) -> tuple[tuple, tuple | None]:
    doc_id, start, n, total, ids = piece
    if n <= length:
        return piece, None
    return (doc_id, start, length, total, ids[: length * 4]), (doc_id, start + length, n - length, total, ids[length * 4 :])


def _packed(path: str, capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches):
        enc, bins, sequence = encoder(WordEncoder, path), Harmonic(capacity), TaskContext.get().partitionId() << 32

        def rows():
            nonlocal sequence
            out = []
            for bin_ in bins.closed:
                offset = 0
                for p in bin_:
                    out.append((*p[:4], sequence, offset, p[4]))
                    offset += p[2]
                sequence += 1
            bins.closed = []
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            arrays = [*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").cast(pa.binary()).to_pylist()), strict=True):
                bins.add(doc_id, ids + end)
            yield rows()
        bins.finish()
        yield rows()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text) with their place: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Every worker fills the bins of its classes without seeing the others, and holds no more than their open bins; a
    sequence's number is its worker's and a counter. Nothing is shuffled, and no sequence needs padding.

    Null text is an empty document (one end id); null or repeated doc_ids are kept as they come; other columns are
    ignored; an empty table gives no piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_packed(tokenizer, capacity, end_id), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids (stored as little-endian unsigned 32-bit integers) instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all whole documents in sequences of 4096 ids, with their crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
