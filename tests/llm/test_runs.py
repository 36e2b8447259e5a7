"""Periodic runs against a scan of every period, and the query against a model of its contract."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from graphloom.llm import runs

D = "/root/testdata/sf0.001"


def scan(x, least=12):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("least", [1, 5, 12, 30])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randrange(0, 160)
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(0, 4) if n > 4 else 0):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a + p, min(n, a + rng.randrange(1, n))):
                x[i] = x[i - p]
        assert runs.find_runs(np.array(x, np.int64), least) == scan(x, least), x


def test_very_long_texts_stay_fast():
    rng = random.Random(3)
    texts = [[0] * 300_000, [0] * 40_000 + [1] + [0] * 40_000, list(range(1000)) * 200, [rng.randrange(2) for _ in range(100_000)], [rng.randrange(5000) for _ in range(300_000)]]
    began = time.time()
    assert [len(runs.find_runs(np.array(x, np.int64))) > 0 for x in texts] == [True, True, True, True, False]
    assert time.time() - began < 60


def model(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found, gone = scan(w), set()
    for s, k, q in found:
        gone.update(range(s + q, s + k))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    docs = [r for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 3000]
    got = {r.doc_id: tuple(r) for r in runs.op11_runs(spark, D).collect()}
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(got[r.doc_id] == model(*r) for r in docs)
    assert any(got[r.doc_id][1] for r in docs)


def test_edge_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \t\n", "one", "a " * 13, "é ü " * 9, "a b\x0bc d " * 6, "x " * 11, "k l m " * 5 + "n " + "k l m " * 5]
    rows = [(i, t) for i in [None, 1, 1, *ids[:3]] for t in texts]
    df = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id long, text string, runs string, h int")
    assert as_rows(runs.digest(runs.periodic_runs(runs.with_cycles(df)))) == sorted((model(*r) for r in rows), key=repr)
    assert runs.digest(runs.periodic_runs(df.limit(0))).count() == 0
