"""Whitening against exact sums and a dense eigenvalue solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from bitexture.llm import feast
from bitexture.llm import whitening as wh
from bitexture.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, n int, component string, __x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "x", 2) for i, x in rows], SCHEMA)


def check(rows, found, components=16):
    """``found`` against ``rows`` (vec_id, list) of finite vectors."""
    x = [(i, [math.floor(64 * float(np.float32(v))) + 1_000_000 for v in r]) for i, r in rows]
    fit = sorted({tuple(r) for _, r in x})
    n, d = len(fit), len(fit[0])
    total = [sum(r[k] for r in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, total)] for r in fit])
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    k = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    assert len(found) == len(rows) * k and {r.component for r in found} == set(range(1, k + 1))
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    by = {}
    for r in found:
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, r in x:
        mine = by[(i, sum((n * v - s) ** 2 for v, s in zip(r, total)))]
        z = np.array([float(Fraction(n * v - s, n)) for v, s in zip(r, total)]) @ w[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            for got in mine[c + 1]:
                if abs(z[c]) > 1e-3:
                    signs.setdefault(c, np.sign(got * z[c]))
                assert got * signs.get(c, 1) == pytest.approx(z[c], abs=1e-8)
    for r in found:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def gaussian(n, d, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) @ np.diag(np.linspace(3, 0.3, d)) + rng.normal(0, 4, d)
    return [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("d", [1, 5, 24])
def test_against_dense_solver(spark, d):
    rows = gaussian(300, d)
    rows += [(i, rows[0][1]) for i in range(300, 500)]  # a hot vector counts once
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1])]
    odd = [(None, None), (600, None), (601, []), (602, [math.nan] * d), (603, [math.inf] * d), (604, [None] * d), (605, [1.0] * (d + 1))]
    got = wh.whiten_vectors(frame(spark, rows + odd))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, got.collect())


def test_large_entries(spark):
    rows = [(i, [v * 1e7 for v in r]) for i, r in gaussian(200, 4)]
    check([(i, [float(np.float32(v)) for v in r]) for i, r in rows], wh.whiten_vectors(frame(spark, rows)).collect())
    with pytest.raises(Exception, match="entry"):
        wh.whiten_vectors(frame(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_no_variance(spark):
    assert wh.whiten_vectors(frame(spark, [])).collect() == []
    assert wh.whiten_vectors(frame(spark, [(1, None)])).collect() == []
    assert wh.whiten_vectors(frame(spark, [(i, [0.5, 1.0]) for i in range(9)])).collect() == []
    found = wh.whiten_vectors(frame(spark, [(i, [0.5, float(i)]) for i in range(9)])).collect()
    assert len(found) == 9 and all(r.explained == pytest.approx(1) for r in found)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, QUERIES["op12_whitening"].run(spark, sf).collect())


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (100, 2**30, 2**40):
        y = rng.integers(-top, top, (5_000, 3))
        o = y.astype(object)
        assert (wh.exact_products(y) == o.T @ o).all()


MATRICES = {
    "equal": np.eye(20),
    "equal at the border": np.diag([9.0] * 3 + [5.0] * 8 + [1.0] * 9),
    "nearly equal": np.diag([1.0] * 6 + [1 - 1e-13] * 6 + [0.5] * 8),
    "steep": np.diag(np.geomspace(1, 1e-9, 20)),
    "one": np.ones((20, 20)),
    "none": np.zeros((20, 20)),
}


@pytest.mark.parametrize("name", MATRICES)
@pytest.mark.parametrize("most", [1, 5, 16, 40])
def test_eigenpairs(name, most):
    m = MATRICES[name]
    q = np.linalg.qr(np.random.default_rng(1).normal(size=m.shape))[0]
    m = q @ m @ q.T
    m = (m + m.T) / 2
    e, v = feast.largest_eigenpairs(m, most)
    want = np.linalg.eigvalsh(m)[::-1]
    count = min(most, int((want > 1e-11 * max(want[0], 1e-300)).sum()))
    assert len(e) == count and np.allclose(e, want[:count], rtol=0, atol=1e-12 * max(want[0], 1e-300))
    assert np.allclose(v.T @ v, np.eye(count), atol=1e-12)
    assert np.allclose(m @ v, v * e, atol=1e-12 * max(want[0], 1.0))


def test_inertia_counts():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    count, values = feast.inertia_counter(a), np.linalg.eigvalsh(a)
    for t in [*(values[:-1] + values[1:]) / 2, -1e6, 1e6]:
        assert count(t) == (values < t).sum()
