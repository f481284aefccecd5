"""Whitening and centroid clustering against plain versions, with odd rows and hot vectors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from flowstream.llm.centroids import Orchard, centroid_clusters
from flowstream.llm.whitening import merged, moments, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, cluster string, `a.b` int"


def vectors(spark, rows, dtype="float"):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA.replace("float", dtype))


def plain_rows(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 0.2) * (1 + d), 6) for d in range(dims)]) for i in range(n)]


def odd_rows(dims):
    good = plain_rows(60, dims, 3)
    bad = [(100, None), (101, [None] * dims), (102, [float("nan")] + [0.0] * (dims - 1)), (103, [float("inf")] + [0.0] * (dims - 1)), (104, [-float("inf")] * dims)]
    return good + bad + [(None, good[0][1]), (5, good[5][1]), (5, good[6][1]), (7, [0.0] * dims), (8, [-0.0] * dims), (105, []), (106, [1.0])]


def integers(v):
    return [math.floor(64 * float(np.float32(c))) for c in v]


def plain_whitening(rows, components):
    kept = [(i, [a + 1_000_000 for a in integers(v)]) for i, v in rows]
    x = np.array([v for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = ((x * n - sums) / n).astype(float)
    cov = d.T @ d / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    return [i for i, _ in kept], [int(((a * n - sums) ** 2).sum()) for a in x], d @ (axes[:, :k] / np.sqrt(values[:k])), values[:k] / np.trace(cov)


@pytest.mark.parametrize("hot", [0, 1500])
def test_whitening_matches_plain(spark, hot):
    dims = 6
    rows = odd_rows(dims) + [(1000 + i, [0.25] * dims) for i in range(hot)]
    got = whiten(vectors(spark, rows), components=4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    usable = [(i, v) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    ids, deviations, white, shares = plain_whitening(usable, 4)
    assert len(got) == len(usable) * 4 and {r.n for r in got} == {len(usable)}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, deviations))
    for k in range(4):
        mine = sorted(((r.vec_id is None, r.vec_id, r.deviation), r.whitened) for r in got if r.component == k + 1)
        want = sorted((((i is None), i, d), w) for i, d, w in zip(ids, deviations, white[:, k]))
        a, b = np.array([w for _, w in mine]), np.array([w for _, w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained - shares[k]) < 1e-12 for r in got if r.component == k + 1)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_of_little(spark):
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []  # no variance
    two = whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0])]), components=5).collect()
    assert [(r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two] == [(1, 2, 128 ** 2, 1.0, 1.0)] * 2
    with pytest.raises(ValueError):
        whiten(vectors(spark, []), weights="none")


def test_whitening_weights_and_wide_values(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [4.0, 0.0]), (5, [0.0, 4.0])]
    once = {r.n for r in whiten(vectors(spark, rows), weights="one").collect()}
    assert once == {3}
    wide = whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "double")).collect()
    assert {r.deviation for r in wide if r.vec_id in (1, 2)} == {None} and all(math.isfinite(r.whitened) for r in wide)


def test_whitening_independent_of_partitions(spark):
    rows = plain_rows(300, 5, 9) + plain_rows(40, 5, 9)
    runs = []
    for parts in (1, 7):
        got = whiten(vectors(spark, rows).repartition(parts), components=5).collect()
        runs.append(sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in got))
    assert runs[0] == runs[1]


def test_moments_merge():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(50, 3)) + 1e6, rng.integers(1, 9, 50).astype(float)
    whole = moments(x, w)
    parts = merged(merged(None, moments(x[:13], w[:13])), moments(x[13:], w[13:]))
    np.testing.assert_allclose(parts[2], whole[2], rtol=1e-9)
    np.testing.assert_allclose(whole[2], np.cov(x.T, fweights=w.astype(int), ddof=0) * w.sum(), rtol=1e-6)


def plain_clusters(rows, k, rounds):
    x = [integers(v) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda r: (hashlib.sha256(f"1:{'' if rows[r][0] is None else rows[r][0]}".encode()).hexdigest(), x[r]))
    centres = [x[r] for r in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min(range(len(centres)), key=lambda c: (dist(v, centres[c]), c)) for v in x]
    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            mine = [v for v, f in zip(x, found) if f == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    ds = [dist(v, centres[f]) for v, f in zip(x, found)]
    by = Counter()
    for f, d in zip(found, ds):
        by[f] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((r[0], f, d, by[f], sum(ds), digest[f]) for r, f, d in zip(rows, found, ds))


@pytest.mark.parametrize("k,rounds,dims", [(16, 3, 6), (3, 2, 6), (1, 1, 6), (200, 2, 6)])
def test_clusters_match_plain(spark, k, rounds, dims):
    rows = odd_rows(dims) + [(1000 + i, [0.25] * dims) for i in range(50)]
    got = centroid_clusters(vectors(spark, rows).repartition(5), k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    usable = [(i, v) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    assert Counter(map(tuple, got.collect())) == plain_clusters(usable, k, rounds)


def test_clusters_of_little(spark):
    assert centroid_clusters(vectors(spark, []), dims=4).collect() == []
    assert centroid_clusters(vectors(spark, [(1, None), (2, [1.0])]), dims=4).collect() == []
    same = centroid_clusters(vectors(spark, [(i, [0.5] * 4) for i in range(40)]), dims=4).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}  # of equal centroids the smallest number


def test_clusters_of_wide_values(spark):
    rows = [(1, [1e12, 0.0]), (2, [1e12 + 1, 0.0]), (3, [-1e12, 5.0]), (4, [0.0, 0.0])]
    got = {r.vec_id: r for r in centroid_clusters(vectors(spark, rows, "double"), k=2, rounds=2, dims=2).collect()}
    assert len({got[1].cluster, got[2].cluster}) == 1 and got[1].distance is not None
    assert all(r.inertia is None for r in got.values()) or all(r.distance is not None for r in got.values())


def test_orchard_is_exact_and_skips():
    rng = np.random.default_rng(4)
    centres = rng.integers(-50, 50, (24, 3)).tolist()
    centres[7] = centres[3]  # equal centroids
    x = np.concatenate([rng.integers(-60, 60, (3000, 3)), np.array(centres)])
    x[:200] = (np.array(centres)[rng.integers(0, 24, 200)] + np.array(centres)[rng.integers(0, 24, 200)]) // 2  # near ties
    search = Orchard(centres)
    found, least = search.nearest(x)
    every = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert search.compared < 0.8 * every.size
