"""Centroid clustering against a plain version over all pairs."""

import hashlib
import math

import numpy as np
import pytest

from bitexture.llm import clustering as cl


def plain(rows, clusters=16, rounds=3, width=64):
    """vec_id, cluster, distance of ``rows`` (vec_id, list) by comparing all."""
    kept = [
        (i, np.array([math.floor(64 * float(v)) for v in x], dtype=object))
        for i, x in rows
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)
    ]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), list(x)) for i, x in kept if i is not None]
    centroids = [np.array(x, dtype=object) for _, x in sorted(named)[:clusters]]

    def assign():
        apart = [[int(((x - c) ** 2).sum()) for c in centroids] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in apart]

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            mine = [x for (_, x), (n, _) in zip(kept, of) if n == c]
            if mine:
                centroids[c] = np.array([int(s) // len(mine) for s in sum(mine)], dtype=object)
    return sorted(((i, n, d) for (i, _), (n, d) in zip(kept, assign())), key=str), centroids


SCHEMA = "vec_id bigint, embedding array<float>, cluster int, distance string, __id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "x", 1) for i, x in rows], SCHEMA)


def groups(n, seed=3, width=64):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (5, width))
    x = (middles[rng.integers(0, 5, n)] + rng.normal(0, 0.05, (n, width))).astype(np.float32)
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def test_against_all_pairs(spark):
    rows = groups(700)
    rows += [(i, rows[0][1]) for i in range(700, 1100)]  # a hot vector
    rows += [(5, rows[9][1]), (5, rows[9][1]), (6, rows[1][1])]  # repeated ids
    rows += [(None, rows[2][1]), (None, None), (2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65)]
    rows += [(2004, [math.nan] + [0.5] * 63), (2005, [math.inf] + [0.5] * 63), (2006, [None] + [0.5] * 63)]
    got = cl.cluster_vectors(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    found = got.collect()
    want, centroids = plain(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=str) == want
    assert {r.inertia for r in found} == {sum(d for _, _, d in want)}
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid == list(centroids[r.cluster])


def test_large_entries_few_rows_and_none(spark):
    rows = [(i, [float(v)] * 64) for i, v in enumerate([1e5, -1e5, 9e4, 0.0, 1e5])]
    found = cl.cluster_vectors(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == plain(rows)[0]
    assert cl.cluster_vectors(frame(spark, [])).collect() == []
    assert cl.cluster_vectors(frame(spark, [(None, [0.5] * 64), (1, None)])).collect() == []
    with pytest.raises(Exception, match="entry"):
        cl.cluster_vectors(frame(spark, [(1, [1e30] * 64)])).collect()


def test_hilbert_keys_walk_through_neighbours():
    dims, bits = 3, 3
    cells = np.array(np.meshgrid(*[range(8)] * dims)).reshape(dims, -1).T
    keys = cl.hilbert_keys(cells, bits)
    assert len(set(keys.tolist())) == len(cells)
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_never_lose_the_nearest_and_spare_comparisons():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-80, 80, (12, 8))
    centroids[7] = centroids[3]  # equally near ones
    boxes = [centroids[rng.integers(12)] + rng.integers(-25, 25, (40, 8)) for _ in range(60)]
    kept = cl.candidates(np.array([b.min(0) for b in boxes]), np.array([b.max(0) for b in boxes]), centroids)
    for box, some in zip(boxes, kept):
        all_of = ((box[:, None, :] - centroids) ** 2).sum(2).argmin(1)
        assert some[all_of].all()
        numbers = np.flatnonzero(some)
        assert (numbers[cl.nearest(box, centroids[numbers])[0]] == all_of).all()
    assert kept.mean() < 0.5 and not kept[:, 7].any()
