import hashlib
import time
from collections import Counter

import numpy as np

from graphloom.llm import shingles


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 400, 3000):
        for share in (0.5, 0.75, 0.8, 0.85, 0.9, 1.0):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[: int(np.ceil(share * n))], rng.integers(0, 2**63, int(n * rng.random() * 0.2), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            a, b = (np.frombuffer(shingles.sketch(s), np.uint64)[None, :] for s in (x, y))
            may = shingles.may_link(a, b, np.array([len(x)]), np.array([len(y)]), 0.8)[0]
            assert may or both < 0.8 * (len(x) + len(y) - both) - 1e-9


def test_prefixes_cost_no_pass_over_the_frequent_shingles(monkeypatch):
    rng = np.random.default_rng(5)
    often = np.unique(rng.integers(0, 2**63, 200_000, dtype=np.uint64))
    cases = [(np.unique(np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), rng.choice(often, m)])), o) for n, m in ((0, 1), (1, 0), (5, 4), (300, 80), (0, 40)) for o in (often, often[:1], often[:0])]
    want = [x[np.lexsort((x, np.isin(x, o)))[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1]] for x, o in cases]
    monkeypatch.setattr(np, "isin", None)
    began = time.process_time()
    assert all(np.array_equal(shingles.prefix(x, o, 0.8), w) for (x, o), w in zip(cases, want, strict=True))
    for _ in range(200):
        shingles.prefix(*cases[9], 0.8)
    assert time.process_time() - began < 1  # some 20 s where each text sorted all 200,000


def test_few_pairs_of_unlike_texts_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(4)
    line = " ".join(f"c{i}" for i in range(30))
    texts = [line + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(300)]
    texts += [texts[0] + " more", texts[0] + " else", " ".join(f"s{i}" for i in range(200))]
    seen, linked = [], shingles._linked
    monkeypatch.setattr(shingles, "_linked", lambda pairs, *a: seen.append(pairs.count()) or linked(pairs, *a))
    got = shingles.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == 303 and len({r["root"] for r in got}) == 301
    assert sum(seen) < 300


def test_simhash_finds_links_without_lists(spark, monkeypatch):
    monkeypatch.setattr(shingles, "prefix", lambda have, often, similarity: have[:0])
    base = [f"w{i}" for i in range(900)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(f"v{i}" for i in range(900))]
    got = {r["hash"]: r["root"] for r in shingles.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(got) == 3 and len(set(got.values())) == 2


def test_groups_that_sketches_do_not_tell_apart_make_no_pairs(spark, monkeypatch):
    base, other = [f"w{i}" for i in range(300)], [f"w{i}" if not 100 <= i < 129 else f"v{i}" for i in range(300)]
    texts = [" ".join([*words, f"{name}{i}"]) for name, words in (("x", base), ("y", other)) for i in range(40)]
    made, stage = {}, shingles.stage

    def counted(df, name="stage"):
        out = stage(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shingles, "stage", counted)
    got = shingles.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(got) == 80 and sorted(Counter(r["root"] for r in got).values()) == [40, 40]
    assert made["pairs"] < 2 * 80 and made["decided"] == 0


def test_links_that_only_blocks_find_are_kept(spark):
    rng = np.random.default_rng(6)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(12):
            words = list(words)
            for at in rng.integers(0, len(words), 1):
                words[at] = f"r{rng.integers(10**9)}"
            texts.append(" ".join(words))
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                up = [up[j] if x == up[i] else x for x in up]
    got = {r["hash"]: r["root"] for r in shingles.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    roots = [got[hashlib.md5(t.encode()).hexdigest()] for t in texts]
    assert len(set(zip(roots, up, strict=True))) == len(set(roots)) == len(set(up))
