"""The linker against naive searches."""

import math
import random
from collections import Counter

import pytest

from graphloom.operators import linker

D = "/root/testdata/sf0.001"


def naive(text, alias):
    text, at, out = linker.folded(text or ""), -1, []
    while (at := text.find(alias, at + 1)) >= 0:
        out.append(at)
    return out


@pytest.mark.parametrize("shard", [64 << 20, 200])
def test_hits_in_documents(spark, monkeypatch, shard):
    """With `shard` 200 several automata share the aliases."""
    monkeypatch.setattr(linker, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(3)
    names = {" ".join(rng.choice(texts)[1].split()[:2]) for _ in range(30)} | {"the", "an", "ana", "a", "é", "nowhere to be found"}
    rows = [(x, f"C{i}") for i, x in enumerate(sorted(names))] + [("THE", "C"), (None, "C1"), ("", "C2")]
    got = linker.alias_hits(docs, spark.createDataFrame(rows, "alias string, cui string")).collect()
    low = {x.lower() for x in names}
    want = {(i, s, s + len(a), a) for i, t in texts for a in low for s in naive(t, a)}
    assert len(got) == len(want) and {(r.doc_id, r.start, r.end, r.alias) for r in got} == want
    assert {r.cui for r in got if r.alias == "the"} == {"C"}


def test_whole_words_and_edge_rows(spark):
    docs = spark.createDataFrame([(1, "Aspirin, aspirins; ASPIRIN"), (1, None), (None, "x aspirin"), (3, "")], "doc_id long, text string")
    names = spark.createDataFrame([("aspirin", "C1")], "alias string, cui string")
    got = {(r.doc_id, r.start) for r in linker.alias_hits(docs, names, whole_words=True).collect()}
    assert got == {(1, 0), (1, 19), (None, 2)}
    assert linker.alias_hits(docs, names.limit(0)).count() == 0 and linker.alias_hits(docs.limit(0), names).count() == 0


def test_best_aliases(spark):
    rng = random.Random(5)
    parts = ["aspirin", "gastric", "bleeding", "ulcer", "acid", "liver", "failure", "acute", "heart", "of the", "ibuprofen"]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(120)})
    asked = sorted({x[: rng.randrange(1, len(x) + 1)] + rng.choice(["", "s", " x"]) for x in names} | {"zzz qqq", "Acute HEART"})
    grams = lambda t: Counter((" " + t.lower() + " ")[i : i + 3] for i in range(len(t)))
    df = Counter(g for x in names for g in set(grams(x)))

    def vector(t):
        w = {g: n * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    known, want = {x: vector(x) for x in names}, set()
    for t in asked:
        v = vector(t)
        score = {a: round(sum(x * w.get(g, 0.0) for g, x in v.items()), 9) for a, w in known.items()}
        a = min(score, key=lambda a: (-score[a], a))
        if score[a] >= 0.5:
            want.add((t.lower(), a, round(score[a], 6)))
    rows = linker.link_mentions(spark.createDataFrame([(x,) for x in [*asked, None, ""]], "mention string"), spark.createDataFrame([(x, f"C{i}") for i, x in enumerate(names)], "alias string, cui string")).collect()
    assert {(r.mention, r.alias, round(r.score, 6)) for r in rows} == want and 20 < len(want) < len(asked)
