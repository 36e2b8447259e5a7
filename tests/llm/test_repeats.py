"""Repeated strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import repeats

D, LENGTH = "/root/testdata/sf0.001", 200


def removed(text, seen):
    out = bytearray(len(text))
    for i in range(len(text) - LENGTH + 1):
        if seen(text[i : i + LENGTH]):
            out[i : i + LENGTH] = b"\1" * LENGTH
    return out


def row(doc_id, text, gone):
    kept = bytes(x for x, r in zip(text, gone, strict=True) if not r)
    return doc_id, len(text), sum(gone), sum(1 for i, r in enumerate(gone) if r and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()


def everywhere(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[i : i + LENGTH] for _, t in texts for i in range(len(t) - LENGTH + 1))
    return Counter(row(i, t, removed(t, lambda x: count[x] > 1)) for i, t in texts)


def later(rows):
    seen, out = set(), Counter()
    for i, t in rows:
        text = (t or "").encode()

        def known(x):
            old = x in seen
            seen.add(x)
            return old

        out[row(i, text, removed(text, known))] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(60) for _ in range(6)]
    out = [None, "", "z" * 5000, "ab" * 400, "abc " * 300 + prose(20), "abc " * 200, "y" * 199, "y" * 199, "w" * 200, "v" * 201]
    for _ in range(110):
        t = prose(rng.randrange(1, 200))
        if rng.random() < 0.5:
            t = prose(20) + " " + rng.choice(passages) + " " + t
        if rng.random() < 0.3:
            t += " " + rng.choice(passages)[: rng.randrange(150, 400)] + " " + prose(10)
        if rng.random() < 0.2:
            t = rng.choice(out) or ""
        if rng.random() < 0.2:
            old = rng.choice(out) or "x"
            at = rng.randrange(len(old))
            t = old[:at] + "Q" + old[at + 1 :]
        out.append(t)
    return out


@pytest.mark.parametrize("limit", [512, 3])
def test_repeats(spark, monkeypatch, limit):
    """With limit 3, most anchors are dealt by hashes."""
    monkeypatch.setattr(repeats, "LIMIT", limit)
    rows = [(None if i % 37 == 5 else i // 2 if i % 11 == 0 else i, t) for i, t in enumerate(texts(5))]
    df = spark.createDataFrame([(i, t, 1, "at") for i, t in rows], "doc_id long, text string, t int, marks string").repartition(5)
    assert result(repeats.remove_repeats(df, keep_first=False)) == everywhere(rows)
    rows = list(enumerate(texts(6)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(repeats.remove_repeats(df)) == later(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in repeats.op12_repeats(spark, D).collect())
    assert got == everywhere(rows)
    assert any(r[2] for r in got)


def test_factors_by_definition():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    starts = np.arange(0, 280)
    before, after = repeats.longest_factors(data, starts, 20)

    def common(i, j):
        return next((k for k in range(20) if data[i + k] != data[j + k]), 20)

    for i in starts:
        assert before[i] == max((common(i, j) for j in range(i)), default=0)
        assert after[i] == max((common(i, j) for j in range(i + 1, 280)), default=0)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1 << 10)
    rows = list(enumerate(texts(7)[:40]))
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("z", F.lit(1)), keep_first=False)) == everywhere(rows)


def test_too_short_strings_are_refused(spark):
    with pytest.raises(ValueError, match="at least"):
        repeats.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=50)
