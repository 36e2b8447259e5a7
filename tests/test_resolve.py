"""Operators without SQL against brute-force versions."""

import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import learning, qa, resolve, stability


def vectors(spark, x, group):
    return spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, group, strict=True))], "vec_id long, embedding array<double>, g string")


def linked(x, threshold):
    """Average linkage by definition: the closest pair of clusters, first by their smallest members, while at the threshold."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = [[i] for i in range(len(x))]
    while len(parts) > 1:
        best = max(((np.mean([u[i] @ u[j] for i in a for j in b]), -ai, -bi) for ai, a in enumerate(parts) for bi, b in enumerate(parts) if ai < bi))
        if best[0] < threshold:
            break
        a, b = -best[1], -best[2]
        parts[a] = parts[a] + parts.pop(b)
    return {i: min(p) for p in parts for i in p}


def test_agglomerative_equals_average_linkage(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 12))
    x = np.concatenate([c + rng.normal(size=(9, 12)) * 0.6 for c in centres])
    group = ["a" if i < 40 else "b" for i in range(len(x))]
    got = {r.vec_id: r.cluster for r in resolve.agglomerative(vectors(spark, x, group), "g", 0.6).collect()}
    want = linked(x[:40], 0.6) | {i + 40: c + 40 for i, c in linked(x[40:], 0.6).items()}
    assert got == want and 8 < len(set(want.values())) < 60


def test_registry(spark):
    rows = [
        (0, "aspirin", "aspirin", "aspirin", [1.0, 0.0]), (1, "Aspirin", "aspirin", "aspirin", None), (2, "gastric bleeding", "gastric bleeding", "bleeding", [0.0, 1.0]),
        (3, "stomach bleeding", "stomach bleeding", "bleeding", [0.7, 0.72]), (4, "low dose aspirin", "low dose aspirin", "dose", [0.75, -0.66]), (5, "", "", "", [1.0, 0.0]),
        (6, "pills", "pills", "pills", [0.76, -0.65]), (7, "Aspirin", "aspirin", "aspirin", None),
    ]
    d = spark.createDataFrame([("s", *r) for r in rows], "set_id string, seq long, entity string, surface string, head string, embedding array<double>")
    got = {r.seq: (r.representative, r.reason, r.near) for r in resolve.registry(d).collect()}
    assert got == {
        0: ("aspirin", "new", None), 1: ("aspirin", "similar", None), 2: ("gastric bleeding", "new", None), 3: ("gastric bleeding", "headword", None),
        4: ("low dose aspirin", "new", "aspirin"), 6: ("low dose aspirin", "similar", None), 7: ("aspirin", "similar", None),
    }
    held = {r.seq: r.reason for r in resolve.registry(d, containment=True).collect()}
    assert held[4] == "contained"
    told = {r.representative: (r.n_mentions, r.n_surfaces, r.preferred, r.n_near) for r in resolve.exported_mapping(resolve.registry(d)).collect()}
    assert told["aspirin"] == (3, 2, "Aspirin", 0) and told["low dose aspirin"][3] == 1
    assert resolve.registry(d.limit(0)).count() == 0


def test_fuzzy_match_loses_nothing(spark):
    rng = np.random.default_rng(1)
    words = ["aspirin", "ibuprofen", "insulin", "warfarin", "heparin", "statin", "gastric bleeding", "type 2 diabetes", "b", "ab", "lung cancer risk factor"]
    terms = set()
    for w in words:
        for _ in range(25):
            t = list(w)
            for _ in range(rng.integers(0, 4)):
                at, kind = rng.integers(0, max(1, len(t))), rng.integers(3)
                if kind == 0 and len(t) > 1:
                    del t[at]
                elif kind == 1:
                    t.insert(at, chr(97 + rng.integers(26)))
                elif t:
                    t[at] = chr(97 + rng.integers(26))
            terms.add("".join(t))
    terms |= {"xspirin", "diabetes type 2", "", "risk factor lung cancer"}
    tokens = lambda s: {w for w in re.findall(r"[a-z0-9]+", s.lower())}
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "term string")
    got = {r.term: (r.match, r.score) for r in resolve.fuzzy_match(make(terms), make(words)).collect()}
    want = {}
    for t in terms:
        scored = []
        for w in words:
            a, b = tokens(t), tokens(w)
            score = max(SequenceMatcher(None, t, w).ratio() if t else 0, len(a & b) / len(a | b) if a | b else 0)
            if score >= 0.82:
                scored.append((-score, w))
        if scored:
            want[t] = (min(scored)[1], round(-min(scored)[0], 6))
    assert got == want and "xspirin" in got


def test_sentence_spans(spark):
    texts = ["One. Two!  Three?", "a\n\nb. c", "no end", "", " . x", "Line\nnext. \n\n Last", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.start, r.stop) for r in resolve.sentence_spans(d).orderBy("doc_id", "pos").collect()]
    want = []
    for i, t in enumerate(texts):
        at = 0
        for m in [*re.finditer(r"(?<=[.!?])\s+|\n+", t or ""), None]:
            stop = m.start() if m else len(t or "")
            if (t or "")[at:stop].strip():
                want.append((i, at, stop))
            at = m.end() if m else stop
    assert got == want
    found = [(r.doc_id, r.start) for r in resolve.mentions_of(spark.createDataFrame([(1, "x the the x the"), (2, "the"), (3, None)], "doc_id long, text string"), "the").orderBy("doc_id", "start").collect()]
    assert found == [(1, 2), (1, 6), (1, 12), (2, 0)]
    e = resolve.mentions_in_sentences(spark.createDataFrame([(1, "A cat. The cat and cat! cats")], "doc_id long, text string"), "cat").orderBy("pos", "start").collect()
    assert [(r.pos, r.start, r.stop) for r in e] == [(0, 2, 5), (1, 4, 7), (1, 12, 15), (2, 0, 3)]


def test_refine_splits_impure_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(6, 4)) + 8, rng.normal(size=(6, 4)) - 8, rng.normal(size=(5, 4))])
    rows = [(i, 0 if i < 12 else 1, "causes" if i < 6 else "treats", v.tolist()) for i, v in enumerate(x)]
    out = {r.id: r.cluster for r in learning.refine(spark.createDataFrame(rows, "id long, cluster long, relation string, embedding array<double>")).collect()}
    assert len({out[i] for i in range(6)}) == len({out[i] for i in range(6, 12)}) == 1 and out[0] != out[6] and {out[i] for i in range(12, 17)} == {1}
    assert {out[0], out[6]} == {0, 2}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK", 3)
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(40, 5)), rng.normal(size=(10, 5))
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "g int, centroid array<double>")
    got = {r.vec_id: r.nearest for r in learning.nearest(vectors(spark, x, ["a"] * 40), centres, "g").collect()}
    assert got == {i: int(np.linalg.norm(c - v, axis=1).argmin()) for i, v in enumerate(x)}


def test_simulation_and_empty_sets(spark):
    t = spark.createDataFrame([("a", "n1", "x", "causes", "y"), ("b", "n1", "x", "related_to", "y"), ("b", "n2", "x", "related_to", "z")], "set_id string, note string, s string, r string, o string")
    lists = {r.set_id: (r.ged, r.jaccard) for r in stability.pairwise(t).collect()}
    assert lists == {"a": ([0.0], [1.0]), "b": ([0.0], [1.0])}
    cells = {(r.set_id, r.i, r.j): r.ged for r in stability.matrix(t).collect()}
    assert cells["b", "n1", "n2"] is None and cells["b", "n1", "n1"] == 0.0
    steps = stability.simulate(t, runs=3).collect()
    assert len(steps) == 9 and all((r.ged is None) == (r.step == 0) for r in steps) and {r.ged for r in steps if r.step} == {2}


def test_questions_with_errors_keep_their_row(spark):
    q = spark.createDataFrame([(1, "a", "?", "b"), (2, "?", "?", "x"), (3, "a", "b", "x")], "q_id long, s string, o string, answer string")
    ranked = spark.createDataFrame([(1, 1, "c"), (1, 2, "B")], "q_id long, rank long, answer string")
    v = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [0.8, 0.6])], "surface string, embedding array<double>")
    got = {r.q_id: r for r in qa.scored(ranked, q, v).collect()}
    assert got[1].exact and not got[1].top1 and got[1].rr == 0.5 and got[2].error and got[3].exact is None
    assert qa.summary(qa.scored(ranked, q, v)).first().n == 1
    p = qa.prompt(spark.createDataFrame([(7, "a causes b")], "line_id long, text string"), spark.createDataFrame([(1, 7, 3, 1)], "q_id long, line_id long, score long, rank long"), q.withColumn("question", F.lit("What?")))
    assert "a causes b" in {r.q_id: r.prompt for r in p.collect()}[1]


def test_display_clusters(spark):
    rng = np.random.default_rng(5)
    labels, facts = [], []
    for g in range(3):
        centres = rng.normal(size=(6, 8))
        for i in range(30):
            v = centres[i % 6] + rng.normal(size=8) * 0.35
            labels.append((g, f"n{i:02d}" + "x" * (i % 4), "" if i % 7 == 0 else f"w{i % 11}" if i % 3 == 0 else f"u{i}", None if i % 10 == 9 else v.tolist()))
        facts.append((g, "the subject", "w3", None, "the object", "nothing", centres[1].tolist()) if g else (g, " ", "w3", None, None, None, None))
    df = spark.createDataFrame(labels, "set_id long, name string, surface string, embedding array<double>")
    fs = spark.createDataFrame(facts, "set_id long, s string, s_surface string, s_embedding array<double>, o string, o_surface string, o_embedding array<double>")
    same = lambda a, b: (a[0] != "" and a[0] == b[0]) or (a[1] is not None and b[1] is not None and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.8)
    want = set()
    for g, s, ss, se, o, os, oe in facts:
        mine = [x for x in labels if x[0] == g]
        root = list(range(len(mine)))
        for i in range(len(mine)):
            for j in range(i):
                if same(mine[i][2:], mine[j][2:]):
                    root = [root[j] if r == root[i] else r for r in root]
        for c in set(root):
            part = [x for x, r in zip(mine, root, strict=True) if r == c]
            shown = s if s.strip() and any(same(x[2:], (ss, se)) for x in part) else o if (o or "").strip() and any(same(x[2:], (os, oe)) for x in part) else max((x[1] for x in part), key=lambda m: (len(m), m))
            want |= {(g, x[1], min(y[1] for y in part), shown) for x in part}
    got = resolve.display_clusters(df, fs, 0.8).collect()
    assert set(map(tuple, got)) == want and len(got) == len(labels)
    assert {"the subject", "the object"} <= {r.display for r in got}
    assert resolve.display_clusters(df.limit(0), fs, 0.8).count() == 0


def test_a_document_of_10_megabytes(spark):
    """Sentences and mentions of one long text take one pass, and meet by buckets."""
    import time

    text = ("word the cat sat. " * 5 + "\n") * 110_000
    df = spark.createDataFrame([(1, text), (2, "x" * 3000 + " the " + "y" * 3000 + ".")], "doc_id long, text string")
    began = time.time()
    rows = resolve.mentions_in_sentences(df, " the ").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("start").alias("b")).collect()
    assert {tuple(r) for r in rows} == {(1, 550_000, 4, 4), (2, 1, 3000, 3000)}
    assert time.time() - began < 60


def test_refinement_equals_a_model(spark):
    """2-means of all impure clusters at once, round by round, against numpy."""
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(14, 5)) * 0.5 for c in rng.normal(size=(9, 5)) * 2])
    relation = [f"r{(i // 14) % 4}" for i in range(len(x))]
    start = [(i // 14) // 3 for i in range(len(x))]
    cluster = np.array(start)
    for _ in range(3):
        names = []
        for c in sorted(set(cluster.tolist())):
            n = sorted((relation[i] for i in np.flatnonzero(cluster == c)))
            k = sorted((n.count(r) for r in set(n)), reverse=True)
            if len(n) >= 4 and len(k) > 1 and k[1] >= max(2, int(len(n) * 0.2)):
                names.append(c)
        if not names:
            break
        free = cluster.max() + 1
        for at, c in enumerate(names):
            i = np.flatnonzero(cluster == c)
            a = x[i[0]]
            m = np.array([a, x[i[((x[i] - a) ** 2).sum(axis=1).argmax()]]])
            for _step in range(20):
                half = ((x[i][:, None] - m) ** 2).sum(axis=2).argmin(axis=1)
                new = np.array([x[i][half == h].mean(axis=0) if (half == h).any() else m[h] for h in (0, 1)])
                done = np.abs(new - m).max() < 1e-9
                m = new
                if done:
                    break
            half = ((x[i][:, None] - m) ** 2).sum(axis=2).argmin(axis=1)
            cluster[i[half == 1]] = free + at
    df = spark.createDataFrame([(i, int(c), r, v.tolist()) for i, (c, r, v) in enumerate(zip(start, relation, x, strict=True))], "id long, cluster long, relation string, embedding array<double>")
    got = {r.id: r.cluster for r in learning.refine(df, rounds=3).collect()}
    assert got == dict(enumerate(cluster.tolist())) and len(set(got.values())) > 5
