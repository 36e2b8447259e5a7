"""The audit against SQL on a given table, and against a model on edge rows."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from graphloom.llm import divergence

D = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def model(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        terms = TERM.findall("".join(c.lower() if c.isascii() else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()

    def f(p, q):
        return floor(Fraction((p - q) ** 2, p + q))

    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}],
                "term": [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top}
    return out


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    want = con.sql(divergence.ORACLE).fetchall()
    got = divergence.op13_divergence(spark, D).collect()
    assert len(got) == len(want) > 0
    assert set(map(tuple, got)) == set(want)


@pytest.mark.parametrize(("chunk", "held"), [(512, 300_000), (3, 40)])
def test_edge_rows(spark, monkeypatch, chunk, held):
    """Also with tiny chunks and partial counts."""
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD", held)
    words = ["Apple", "apple", "ÄPFEL", "äpfel", "x1y", "don't", "日本", "zz", "\x00a", "𝄞", "ﬀ", "q" * 3000]
    texts = [None, "", "123 ..", *[" ".join(words[j] for j in range(len(words)) if (i >> j) & 1 or j == i % 12) for i in range(1, 60)]]
    rows = [(t, ["en", "de", None, "xx"][i % 4] if i % 7 else "en", ["a", "b", None, "ß"][i // 3 % 4]) for i, t in enumerate(texts)] + [(None, "nothing", "a"), (None, "nothing", "b")]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    for least in (1, 3):
        got = divergence.audit(df, min_docs=least, top=4).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == model(rows, least, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_exact_arithmetic():
    counts = np.array([0, 1, 7, 10**12, 9 * 10**12])
    total = 9 * 10**12 + 3
    assert divergence.scaled(counts, total).tolist() == [10**9 * int(c) // total for c in counts]
    assert divergence._vector(np.array([0, 1, 0]), np.array([2**53 + 1, 5, 2]), 3).tolist() == [2**53 + 3, 5, 0]
