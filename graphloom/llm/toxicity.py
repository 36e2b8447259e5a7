"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices

#: Bounds of the fit, all by hash: labelled rows of each class, and windows of one of these rows. All else covers all.
TOXIC_ROWS, ORDINARY_ROWS, ROW_WINDOWS = 2_000, 4_000, 256
WINDOW_WORDS = 12
DICT_TOXIC, DICT_ORDINARY, DICT_HARD = 8_192, 262_144, 65_536
SEGMENT, ROUNDS, TELLING, UNLIKE = 24, 5, 4, 0.9
MINS = 4


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in windows of so many words, A-Z in lower case; each window has a space at both ends."""
    w = text.encode("utf-8").lower().split()
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        compression_level=6, min_match=3, strategy=zstd.STRATEGY_LAZY, window_log=19, hash_log=17, chain_log=17,
        search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    given = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return zstd.ZstdCompressor(dict_data=given, compression_params=params)


def _trained(samples: list[bytes], size: int, ordinary: list[bytes]) -> bytes:
    """Content of a dictionary trained on the samples; too few samples to train on are their own dictionary.

    The trainer goes through the samples from the first, writes its choices from the end of the dictionary, and then
    cuts some of that end off to make room for its tables. Ordinary samples come first, so that the cut meets those.
    """
    lead = _spaced(ordinary, sum(map(len, samples)) // 5)
    try:
        return zstd.train_dictionary(size, [lead[i : i + 80] for i in range(0, len(lead), 80)] + samples, k=SEGMENT, d=8).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _spaced(samples: list[bytes], size: int) -> bytes:
    """Samples at even distances, as many as fit the size."""
    step = max(1.0, sum(map(len, samples)) / max(1, size))
    return b"".join(samples[int(i * step)] for i in range(int(len(samples) / step)))[-size:]


@dataclass
class Model:
    """Dictionaries' contents, the gain from which a window counts, an ordinary window's mean gain, and the bar."""

    toxic: bytes
    ordinary: bytes
    least: int = TELLING
    rate: float = 0.0
    bar: float = 1.0

    def gains(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Bytes that each window saves when the toxic dictionary stands before the ordinary one."""
        plain, more = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        return [np.array([len(plain.compress(w)) - len(more.compress(w)) for w in t], np.int64) for t in texts]

    def distance(self, gains: list[np.ndarray]) -> np.ndarray:
        """What a text's telling windows gain, less what as many ordinary windows gain."""
        return np.array([float(g[g >= self.least].sum()) - self.rate * len(g) for g in gains])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.distance(self.gains([windows(t) for t in texts])) - self.bar, -30, 30)))


def min_hashes(text: str) -> list[int]:
    """Smallest hashes of the text's 5-word shingles under MINS seeds."""
    w = text.encode("utf-8").lower().split()
    shingles = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    return [min(xxhash.xxh64_intdigest(x, k) for x in shingles) >> 1 for k in range(MINS)]


def distinct(rows: list[tuple[list[int], list[bytes]]]) -> list[list[bytes]]:
    """Windows of the rows that share no minimum hash with an earlier one: near copies tell nothing new."""
    seen: set = set()
    out = []
    for mins, w in rows:
        own = set(enumerate(mins))
        if not own & seen:
            out.append(w)
        seen |= own
    return out


def fit(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """Train the dictionaries on windows of toxic and of ordinary texts, and calibrate on those left out, one in three.

    The ordinary dictionary holds ordinary windows. The toxic one is trained on windows of toxic texts: at first on those
    that the ordinary dictionary compresses worst, then, round by round, on those that the last toxic one shortens.
    Ordinary windows that it shortens go into the ordinary dictionary, which takes what both kinds of text share.
    The thresholds are those with the best F0.5 on the texts left out, as clean documents matter most.
    """
    apart = lambda x, left_out: [t for i, t in enumerate(x) if (i % 3 == 2) == left_out]
    ill, fine = [w for t in apart(toxic, False) for w in t], [w for t in apart(ordinary, False) for w in t]
    model = Model(b"", base := _spaced(fine, DICT_ORDINARY))
    if not ill or not fine:
        return model
    plain = _compressor(base)
    cost = lambda some: np.array([len(plain.compress(w)) / len(w) for w in some])
    bar = np.quantile(cost(fine[:: max(1, len(fine) // 20_000)]), UNLIKE)
    picked, hard = [w for w, c in zip(ill, cost(ill), strict=True) if c >= bar], []
    for _ in range(ROUNDS):
        model.toxic = _trained(picked or ill, DICT_TOXIC, fine)
        hard += [w for w, g in zip(fine, model.gains([fine])[0], strict=True) if g >= TELLING]
        model.ordinary = base + _spaced(list(dict.fromkeys(hard)), DICT_HARD)
        picked = [w for w, g in zip(ill, model.gains([ill])[0], strict=True) if g >= TELLING]
    hurt, calm = (model.gains(apart(x, True) or x) for x in (toxic, ordinary))
    best = (-1.0, TELLING, 0.0, 1.0)
    for least in (3, 4, 5, 6):
        rate = sum(float(g[g >= least].sum()) for g in calm) / max(1, sum(map(len, calm)))
        trial = Model(b"", b"", least, rate)
        a, b = trial.distance(hurt), trial.distance(calm)
        for bar in np.arange(1, 25) / 2:
            tp, fp = int((a >= bar).sum()), int((b >= bar).sum())
            best = max(best, (1.25 * tp / max(1.0, tp + fp + 0.25 * len(a)), least, rate, float(bar)))
    model.least, model.rate, model.bar = best[1:]
    return model


def _sampled(batches):
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        some = []
        for w in map(windows, texts):
            if len(w) > ROW_WINDOWS:
                kept = sorted(range(len(w)), key=lambda i: (xxhash.xxh64_intdigest(w[i], 1), i))[:ROW_WINDOWS]
                w = [w[i] for i in sorted(kept)]
            some.append(w)
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_toxic"), pa.array([min_hashes(t) for t in texts], pa.list_(pa.int64())), pa.array(some, pa.list_(pa.binary()))],
            names=["_id", "_toxic", "mins", "windows"],
        )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    TOXIC_ROWS, ORDINARY_ROWS and ROW_WINDOWS bound what comes to the driver: rows by a hash of their id, windows of a
    row by their own hash. Null texts, null ids and labels other than 0 and 1 are not learned from; the larger of two
    labels of a document counts; documents that share an id are each learned from; empty tables give a model that
    calls nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    picked = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most TOXIC_ROWS + ORDINARY_ROWS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    got = rows.join(ids, "_id").select("_id", "_toxic", "text").mapInArrow(_sampled, "_id long, _toxic int, mins array<long>, windows array<binary>")
    got = sorted((r["_id"], r["_toxic"], r["mins"], [bytes(w) for w in r["windows"]]) for r in got.collect())
    return fit(*[distinct([(m, w) for _, y, m, w in got if y == k]) for k in (1, 0)])


def _scored(model: Model, schema: T.StructType):
    names = [f.name for f in schema]

    def run(batches):
        release()
        for b in slices(batches, 512):
            texts = ["" if t is None else t for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(texts), pa.float64())], names=names)

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name`: 0 to 1, 0.5 or more is toxic. Null and empty texts gain nothing and stay below.

    Every whole text is cut into windows of 12 words. A column of docs called `name` is replaced; all others, null
    ids, repeated rows and row counts stay; an empty table stays empty. Only `text` is an input of the score.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
    own = "_" * (1 + max(map(len, docs.columns)))
    return base.withColumn(own, F.col("text").cast("string")).mapInArrow(_scored(model, schema), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents by a model learned from the labels of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
