"""Heap-bounded k-means against plain rounds over all vectors."""

import hashlib
import random

import numpy as np
import pytest

from salvor.llm import clusters


def plain(vectors, k, rounds):
    """cluster and squared distance of each vector, and the centroids; vectors are (id, parts)."""
    order = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in vectors)
    centroids = [list(v) for _, _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(vectors, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [nearest(v) for _, v in vectors], centroids


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance string")


@pytest.mark.parametrize(("k", "rounds", "block"), [(4, 3, 1024), (7, 9, 5), (1, 2, 3), (40, 2, 8)])
def test_same_as_plain_rounds(spark, monkeypatch, k, rounds, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(6)]) for i in range(120)]
    rows += [(3, rows[3][1])] * 4 + [(None, rows[9][1]), (200, [0.0] * 6), (201, [1e300] + [0.0] * 5), (202, [-1e300] + [-0.001] * 5)]
    bad = [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [float("nan")] + [1.0] * 5), (306, [float("inf")] * 6)]
    held = 1 << 26
    whole = [(i, [max(-held, min(held, int(np.floor(x * 8)) if abs(x) < 1e200 else int(np.sign(x)) * held)) for x in v]) for i, v in rows]
    want, centroids = plain(whole, k, rounds)
    found, got_centroids, seen = clusters.cluster_vectors(table(spark, rows + bad).repartition(3), k, rounds, 6, 8)
    assert got_centroids.tolist() == centroids
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(key, ((r.vec_id, r.cluster, r.distance) for r in found.collect()))) == sorted(key((i, c, d)) for (i, _), (d, c) in zip(whole, want, strict=True))
    assert seen[0] == len(rows) and len(seen) == rounds + 1
    sums = clusters.with_inertia(found, got_centroids).collect()
    assert {r.inertia for r in sums} == {sum(d for d, _ in want)}
    for r in sums:
        assert r.cluster_inertia == sum(d for d, c in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_bounds_spare_rescans(spark):
    """Clusters that lie far apart are settled: later rounds look at few vectors or none."""
    rng = random.Random(2)
    rows = [(i, [100.0 * (i % 4) + rng.random() for _ in range(3)]) for i in range(400)]
    _, _, seen = clusters.cluster_vectors(table(spark, rows), 8, 8, 3, 8)
    assert seen[0] == 400 and sum(seen[1:]) < 4 * 400


def test_rescan_pops_only_expired_members():
    vectors = np.array([[0, 0], [1, 0], [10, 0], [6, 0]])
    centroids = np.array([[0, 0], [10, 0]])
    heaps, rows, _, new = clusters.rescan(vectors, None, centroids, np.zeros(2))
    assert sorted(rows.tolist()) == [0, 1, 2, 3] and new.tolist() == [0, 0, 1, 1]
    # Gaps are 10, 8, 10 and 2: a drift of 3 expires the last one only.
    moved, rows, old, new = clusters.rescan(vectors, heaps, np.array([[1, 0], [12, 0]]), np.full(2, 3.0))
    assert rows.tolist() == [3] and old.tolist() == [1] and new.tolist() == [0]
    assert sorted(moved.member[: moved.ends[0]].tolist()) == [0, 1, 3]
    for low, high in zip([0, *moved.ends[:-1]], moved.ends, strict=True):
        part = moved.key[low:high]
        assert all(part[(i - 1) // 2] <= part[i] for i in range(1, len(part)))


def test_ties_and_empty(spark):
    """A vector as near to two centroids goes to the first; a table without whole vectors gives no rows."""
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 5, 5])]
    found, centroids, _ = clusters.cluster_vectors(table(spark, rows), 3, 0, 1, 1)
    want, plain_centroids = plain([(i, [int(v[0])]) for i, v in rows], 3, 0)
    assert centroids.tolist() == plain_centroids
    assert {(r.vec_id, r.cluster, r.distance) for r in found.collect()} == {(i, c, d) for (i, _), (d, c) in zip(rows, want, strict=True)}
    none, centroids, seen = clusters.cluster_vectors(table(spark, [(1, None)]), 3, 2, 1, 1)
    assert clusters.with_inertia(none, centroids).count() == 0 and seen == []
