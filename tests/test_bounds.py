"""Inverted lists, provenance as of a moment and bounded retrieval against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import qa, stability


@pytest.mark.parametrize("shared", [64, 2])
def test_pairs_of_notes(spark, monkeypatch, shared):
    """With `shared` 2 most triples are joined with themselves."""
    monkeypatch.setattr(stability, "SHARED", shared)
    rng = random.Random(2)
    rows = [(g, f"n{rng.randrange(9)}", f"s{rng.randrange(2)}", rng.choice(["causes", "treats", "related_to"]), f"o{rng.randrange(4)}") for g in range(3) for _ in range(60)]
    rows += [(7, "a", "s", "related_to", "o"), (7, "b", "s", "related_to", "o"), (8, "only", "s", "causes", "o")]
    for weak in (False, True):
        graphs = {}
        for g, note, s, r, o in rows:
            graphs.setdefault((g, note), set()).update({(s, r, o)} if weak or r != "related_to" else ())
        want = set()
        for (g, i), a in graphs.items():
            for (h, j), b in graphs.items():
                if g == h and i < j:
                    want.add((g, i, j, len(a ^ b), len(a & b) / len(a | b) if a | b else 1.0))
        got = stability.note_pairs(spark.createDataFrame(rows, "set_id long, note string, s string, r string, o string"), weak).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_sources_as_of_a_moment(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        runs = sorted({rng.randrange(50): f"n{j}" for j in range(rng.randrange(1, 20))}.items())
        rows.append((i, runs, rng.randrange(-1, 52)))
    df = spark.createDataFrame(rows, "id long, runs array<struct<at:long,source:string>>, seq long")
    for r in df.select("runs", "seq", E.sources_before(F.col("runs"), F.col("seq")).alias("a"), E.sources_before(F.col("runs"), F.col("seq"), True).alias("b")).collect():
        assert r.a == [x.source for x in r.runs if x["at"] < r.seq] and r.b == [x.source for x in r.runs if x["at"] <= r.seq]


def test_retrieval(spark):
    rng = random.Random(6)
    words = ["liver", "aspirin", "bleeding", "ulcer", "gastric", "pain", "heart", "insulin", "sugar", "risk", "Of", "the"]
    lines = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) if i % 9 else None) for i in range(150)]
    lines.append((500, "aspirin " * 30_000))
    qs = [(q, [rng.choice([None, "?", "", " Gastric Ulcer ", "ver asp", "in", "sugar risk", "aspirin", "nowhere", "the pain"]) for _ in range(rng.randrange(0, 4))]) for q in range(25)]
    got = qa.retrieve(spark.createDataFrame(qs, "q_id long, anchors array<string>"), spark.createDataFrame(lines, "line_id long, text string"), k=5).collect()
    told = {}
    overlap = {i: set(t) for i, t in spark.createDataFrame([(i, (t or "").lower()) for i, t in lines], "i long, t string").select("i", qa.T.overlap_words(F.col("t"))).collect()}
    for q, anchors in qs:
        use = [x for x in ((a or "").strip().lower() for a in anchors) if x not in ("", "?")]
        mine = set(spark.createDataFrame([(" ".join(use),)], "t string").select(qa.T.overlap_words(F.col("t"))).first()[0])
        score = {i: len(mine & overlap[i]) + sum(4 for a in use if len(a) > 2 and a in (t or "").lower()) for i, t in lines}
        best = sorted((i for i in score if score[i]), key=lambda i: (-score[i], i))[:5]
        told |= {(q, i): (score[i], n) for n, i in enumerate(best, 1)}
    assert {(r.q_id, r.line_id): (r.score, r["rank"]) for r in got} == told and told
