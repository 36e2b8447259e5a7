"""Cosine join and average linkage against all pairs and the sequential definition."""

import numpy as np
import pytest

from graphloom.operators import similarity as S

D = "/root/testdata/sf0.001"


def cluster_cloud(seed, groups, each, dims=12, noise=0.5, common=0.0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + rng.normal(size=(each, dims)) * noise for c in rng.normal(size=(groups, dims))])
    return x + common * np.ones(dims)


def frame(spark, x, group=None):
    return spark.createDataFrame([(i, None if v is None else [float(e) for e in v], (group or [0] * len(x))[i], "q") for i, v in enumerate(x)], "vec_id long, embedding array<double>, g long, ball string")


def all_pairs(x, threshold, group=None):
    u = S.unit(np.asarray(x, np.float64))
    return {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= threshold - 1e-12 and (group is None or group[i] == group[j])}


def roots(n, pairs):
    r = list(range(n))
    for a, b in pairs:
        low, high = sorted((r[a], r[b]))
        r = [low if x == high else x for x in r]
    return dict(enumerate(r))


@pytest.mark.parametrize(("threshold", "common", "block"), [(0.95, 0.0, 1024), (0.7, 0.0, 16), (0.9, 3.0, 16), (0.3, 0.0, 64)])
def test_join_equals_all_pairs(spark, monkeypatch, threshold, common, block):
    """Also with a common direction, low thresholds and bands dealt in blocks."""
    monkeypatch.setattr(S, "BLOCK", block)
    x = cluster_cloud(1, 12, 25, common=common)
    x[7] = x[8] = x[9]
    group = [i % 3 // 2 for i in range(len(x))]
    got = S.cosine_pairs(frame(spark, x, group), threshold, group="g").collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == all_pairs(x, threshold, group)
    parts = {r.id: r.component for r in S.linked_components(frame(spark, x, group), threshold, group="g").collect()}
    assert parts == roots(len(x), all_pairs(x, threshold, group))


def test_edge_rows(spark):
    x = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [2.0, 0.0], [float("inf"), 1.0], [0.0, 3.0], [1e-30, 0.0]]
    df = frame(spark, x)
    assert [(r.a, r.b) for r in S.cosine_pairs(df, 0.9).collect()] == [(0, 4)]
    assert {r.id: r.component for r in S.linked_components(df, 0.9).collect()} == {0: 0, 4: 0, 6: 6}
    assert S.cosine_pairs(df.limit(0), 0.9).count() == 0
    assert S.average_linkage(df.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        S.cosine_pairs(df, 0.0)


def sequential(x, threshold):
    """The closest pair of clusters, first by their smallest members, while at the threshold."""
    u = S.unit(np.asarray(x, np.float64))
    s, size, home = u @ u.T, np.ones(len(u)), np.arange(len(u))
    np.fill_diagonal(s, -np.inf)
    while True:
        i, j = sorted(np.unravel_index(int(s.argmax()), s.shape))
        if s[i, j] < threshold - 1e-12:
            return dict(enumerate(home.tolist()))
        row = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i], s[i, i] = row, row, -np.inf
        s[j], s[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        home[home == j] = i


@pytest.mark.parametrize("local", [1024, 20])
def test_linkage_equals_the_sequential_one(spark, monkeypatch, local):
    """With `local` 20 the rounds run over the cosine join."""
    monkeypatch.setattr(S, "LOCAL", local)
    x = cluster_cloud(2, 9, 20, noise=0.6)
    got = {r.id: r.cluster for r in S.average_linkage(frame(spark, x), 0.6).collect()}
    want = sequential(x, 0.6)
    assert got == want and 8 < len(set(want.values())) < 170


def test_linkage_rounds_are_of_open_clusters(spark, monkeypatch):
    """Clusters without a neighbour at the threshold leave: the rounds end once few are open, not once few are left."""
    rounds, original = [], S.met_blocks
    monkeypatch.setattr(S, "met_blocks", lambda *a: rounds.append(a[0].count()) or original(*a))
    monkeypatch.setattr(S, "LOCAL", 20)
    x = np.random.default_rng(4).normal(size=(120, 6))
    assert {r.id: r.cluster for r in S.average_linkage(frame(spark, x), 0.7).collect()} == sequential(x, 0.7)
    assert len(set(sequential(x, 0.7).values())) > 20 and len(rounds) <= 6 and rounds[-1] < 50


def test_linkage_of_5000_vectors(spark):
    x = cluster_cloud(3, 40, 125, dims=24, noise=0.45)
    got = {r.id: r.cluster for r in S.average_linkage(frame(spark, x), 0.72).collect()}
    home = S.merge_locally(S.unit(x), np.ones(len(x)), 0.72)
    assert got == dict(enumerate(home.tolist()))
    some = np.concatenate([np.arange(i, i + 125) for i in range(0, 1000, 125)])
    assert dict(enumerate(S.merge_locally(S.unit(x[some]), np.ones(len(some)), 0.72).tolist())) == sequential(x[some], 0.72)


def test_low_thresholds_cross_packed_blocks(spark, monkeypatch):
    """Rows are not copied for each ball; blocks meet in a cross join, with the pairs of brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(90)], "vec_id long, embedding array<double>, label int")
    crossed, original = [], S.crossed_blocks
    monkeypatch.setattr(S, "crossed_blocks", lambda *a: crossed.append(1) or original(*a))
    monkeypatch.setattr(S, "PACK", 7)
    monkeypatch.setattr(S, "VISITS", 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 == j % 3 and u[i] @ u[j] >= 0.3}
    got = [(r.a, r.b) for r in S.cosine_pairs(rows, 0.3, group="label").collect()]
    assert crossed and len(got) == len(want) and set(got) == want
