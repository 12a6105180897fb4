"""Integer centroids and whitening against plain recomputation."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from vellum.llm import centroids, whitening

DIMS = 6
SCHEMA = "vec_id long, embedding array<float>, cluster string, key int, x int, component int"


def vectors(n=150, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in r.normal(0, 0.4, DIMS).astype(np.float32)]) for i in range(n)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(900, None), (901, [0.5] * (DIMS - 1) + [None]), (902, [math.nan] + [0.0] * (DIMS - 1)), (903, [math.inf] * DIMS), (904, [0.1] * (DIMS - 1)), (905, []), (906, [0.0] * DIMS)]
    random.Random(1).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def good(rows):
    return [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]


def plain_clusters(rows, k, rounds):
    kept = good(rows)
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centre = [v for _, v in first[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centre = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c for j, c in enumerate(centre)]
    found = [(i, *near(v)) for i, v in kept]
    each = [sum(d for _, d, c in found if c == j) for j in range(len(centre))]
    return [(i, c, d, each[c], sum(each), ",".join(map(str, centre[c]))) for i, d, c in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r[:4]))


@pytest.mark.parametrize(("k", "rounds", "n"), [(16, 3, 150), (4, 1, 150), (3, 6, 40), (16, 3, 2)])
def test_clusters_equal_plain_kmeans(spark, k, rounds, n):
    rows = vectors(n=max(n, 10)) if n > 2 else [(1, [0.5] * DIMS), (2, [-0.5] * DIMS), (3, None)]
    got = centroids.cluster_vectors(frame(spark, rows), k=k, rounds=rounds, dims=DIMS)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert ordered(got.collect()) == ordered(plain_clusters(rows, k, rounds))


def test_clusters_of_odd_tables(spark):
    assert centroids.cluster_vectors(frame(spark, []), dims=DIMS).count() == 0
    assert centroids.cluster_vectors(frame(spark, [(1, None), (2, [1.0])]), dims=DIMS).count() == 0
    rows = vectors(30)
    far = rows + [(1000, [1e30] * DIMS)]
    got = ordered(centroids.cluster_vectors(frame(spark, far), dims=DIMS).collect())
    assert [r for r in got if r[0] == 1000] == [(1000, None, None, None, None, None)]
    assert [r for r in got if r[0] != 1000] == ordered(plain_clusters(rows, 16, 3))
    assert centroids.cluster_vectors(frame(spark, [(1, [1e30] * DIMS)]), dims=DIMS).collect()[0][1] is None
    same = ordered(centroids.cluster_vectors(frame(spark, [(i, [0.25] * DIMS) for i in range(40)]), dims=DIMS).collect())
    assert {r[1:4] for r in same} == {(0, 0, 0)}


def plain_whitening(rows):
    kept = [(i, [x + 1_000_000 for x in v]) for i, v in good(rows)]
    fit = sorted({tuple(v) for _, v in kept})
    x, n = np.array(fit, object), len(fit)
    s = x.sum(0)
    z = n * x - s
    v = ((z.T @ z) / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    return kept, n, s, v, e[::-1], u[:, ::-1]


def test_whitening_equals_plain(spark):
    rows = vectors()
    kept, n, s, v, e, u = plain_whitening(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == (len(kept) + 2) * DIMS and {r["n"] for r in got} == {n}
    assert all(r["identity_error"] <= 1e-9 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
        if r["vec_id"] in (904, 905):
            assert r["deviation"] is None and r["whitened"] is None
        assert abs(r["explained"] / (e[r["component"] - 1] / v.trace()) - 1) < 1e-9
    for i in {i for i, _ in kept}:
        want = sorted((sum((n * a - b) ** 2 for a, b in zip(x, s)), [((n * np.array(x, object) - s) / n).astype(float) @ u[:, c] / e[c] ** 0.5 for c in range(DIMS)]) for k, x in kept if k == i)
        have = {}
        for r in by[i]:
            have.setdefault((r["component"], r["deviation"]), []).append(r["whitened"])
        for d, white in want:
            for c, w in enumerate(white):
                assert any(abs(abs(w) - abs(h)) < 1e-6 for h in have[c + 1, d])


def test_scatter_is_exact(spark):
    r = random.Random(4)
    rows = [[r.randrange(-(1 << 30), 1 << 30), r.randrange(5), 7, r.randrange(1 << 20)] for _ in range(333)]
    fit = spark.createDataFrame([(v,) for v in rows], "x array<int>").repartition(3)
    low = [min(c) for c in zip(*rows)]
    bits = [(max(c) - min(c)).bit_length() for c in zip(*rows)]
    y = np.array(rows, object) - np.array(low, object)
    assert (whitening.scatter(fit, low, bits) == y.T @ y).all()


def test_whitening_of_odd_tables(spark):
    for rows in ([], [(1, None)], [(1, [])], [(i, [0.5] * DIMS) for i in range(9)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [0.1 * i, 1.0, 0.2 * i]) for i in range(20)])).collect()
    assert {r["component"] for r in flat} == {1, 2} or {r["component"] for r in flat} == {1}
    rows = vectors(40) + [(1000, [1e30] * DIMS), (1001, [1.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    odd = [r for r in got if r["vec_id"] in (1000, 1001, 904)]
    assert len(odd) == 3 * DIMS and all(r["deviation"] is None and r["whitened"] is None and r["n"] for r in odd)
    assert {r["n"] for r in got} == {plain_whitening(vectors(40))[1]}
