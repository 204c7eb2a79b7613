"""Eigenpairs of a symmetric matrix by contour integration (FEAST), with counts
by inertia. For the small matrices of statistics that Spark has summed up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Quadrature points on the upper half of the circle around an interval.
POINTS = 8
#: Eigenvalues of one interval at most, unless they are too close to part.
PER_INTERVAL = 8
#: Eigenvalues closer than this, relative to the bound of all, aren't parted.
_CLOSE = 1e-10
_ROUNDS = 30


def inertia_counter(matrix: np.ndarray) -> Callable[[float], int]:
    """``count(t)``: how many eigenvalues are below ``t``, which is the number of
    negative pivots of ``matrix - t`` (law of inertia). The matrix is first
    brought to three diagonals by reflections, which keeps the inertia of every
    shift and makes the pivots cheap and stable."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    main, off = a.diagonal().copy(), a.diagonal(-1).copy() if n > 1 else np.zeros(0)
    tiny = np.finfo(np.float64).tiny * max(1.0, float((off * off).max(initial=0.0)))

    def count(t: float) -> int:
        negative, pivot = 0, 1.0
        for i in range(n):
            pivot = main[i] - t - (off[i - 1] ** 2 / pivot if i else 0.0)
            if abs(pivot) < tiny:
                pivot = -tiny
            negative += pivot < 0
        return negative

    return count


def _intervals(count: Callable[[float], int], low: float, high: float, smallest: float) -> list[tuple[float, float, int]]:
    """Parts of (low, high] with their number of eigenvalues, cut in gaps: the
    cut is where the count stays the same over the widest stretch near the middle."""
    inside = count(high) - count(low)
    if inside <= PER_INTERVAL or high - low <= smallest:
        return [(low, high, inside)] if inside else []
    grid = np.linspace(low, high, 65)
    counts = np.array([count(t) for t in grid])
    best = None
    at = 0
    while at < 64:
        end = at
        while end < 64 and counts[end + 1] == counts[at]:
            end += 1
        parts = counts[at] - counts[0], counts[-1] - counts[at]
        if min(parts) > 0:
            value = (end - at + 1) * min(parts)
            if best is None or value > best[0]:
                best = value, (grid[at] + grid[end]) / 2
        at = end + 1
    if best is None:  # all within one cell of the grid; one more on either side keeps the edges away
        cell = int(np.argmax(np.diff(counts)))
        return _intervals(count, float(grid[max(cell - 1, 0)]), float(grid[min(cell + 2, 64)]), smallest)
    return _intervals(count, low, float(best[1]), smallest) + _intervals(count, float(best[1]), high, smallest)


def _in_interval(matrix: np.ndarray, low: float, high: float, wanted: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` eigenpairs in an interval: random vectors are projected on
    its eigenspace by quadrature of resolvents around a circle, and Rayleigh-Ritz
    takes the pairs out of the space; repeated until the residuals are those of
    double precision."""
    n = len(matrix)
    middle, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi * (x + 1) / 2)
    # half circle; the other half is the conjugate
    shifts, weights = middle + radius * turn, w * radius * turn / 2
    resolvents = np.stack([z * np.eye(n) - matrix for z in shifts])
    size = min(n, max(wanted + 4, 2 * wanted))
    rng = np.random.Generator(np.random.PCG64(11))
    while True:
        space, settled = rng.normal(size=(n, size)), None
        for _ in range(_ROUNDS):
            solved = np.linalg.solve(resolvents, np.broadcast_to(space.astype(complex), (POINTS, *space.shape)))
            basis, _ = np.linalg.qr((weights[:, None, None] * solved).sum(0).real)
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            space = basis @ small
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(matrix @ space[:, inside] - space[:, inside] * values[inside], axis=0)
            if inside.sum() == wanted:
                worst = residual.max(initial=0.0)
                if worst <= 64 * np.finfo(float).eps * scale or (settled is not None and worst >= settled / 2 and worst < 1e-10 * scale):
                    return values[inside], space[:, inside]
                settled = worst
        if size == n:
            raise ArithmeticError(f"{wanted} eigenvalues in ({low}, {high}], found {int(inside.sum())}")
        size = min(n, 2 * size)


def largest_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest positive eigenvalues, falling, and unit eigenvectors
    as columns, the largest entry of each (the first of several) positive.

    Inertia counts find the cut below the wanted eigenvalues and part the rest
    into intervals; every interval has to yield as many pairs as its count says,
    else the search goes on with a larger space. Eigenvalues of rounding size
    (below 64 n eps times the largest) count as zero and are left out. Equal
    eigenvalues get some orthonormal basis of their space.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(1).max(initial=0.0))
    if not n or scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    count = inertia_counter(matrix)
    floor = 64 * n * np.finfo(float).eps * scale
    high = scale * (1 + 1e-9)
    wanted = min(most, n - count(floor))
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    # the cut: at least ``wanted`` eigenvalues above it, and no more than needed
    low, above = floor, high
    for _ in range(200):
        middle = (low + above) / 2
        if middle in (low, above) or n - count(low) == wanted:
            break
        if n - count(middle) >= wanted:
            low = middle
        else:
            above = middle
    if n - count(low) == wanted:  # to the middle of the gap below, away from the eigenvalues
        under, over = low, above
        for _ in range(60):
            middle = (under + over) / 2
            if n - count(middle) == wanted:
                under = middle
            else:
                over = middle
        bottom, top = floor, low
        for _ in range(60):
            middle = (bottom + top) / 2
            if n - count(middle) == wanted:
                top = middle
            else:
                bottom = middle
        low = max(floor, (top + under) / 2)
    else:  # equal ones at the border: all of them
        low = max(floor, low - _CLOSE * scale)
    values, vectors = [], []
    for a, b, inside in _intervals(count, low, high, _CLOSE * scale):
        e, v = _in_interval(matrix, a, b, inside, scale)
        values.append(e)
        vectors.append(v)
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    if len(values) != n - count(low):
        raise ArithmeticError("eigenvalues are missing")
    for i in range(vectors.shape[1]):  # intervals don't know of one another
        for _ in range(2):
            vectors[:, i] -= vectors[:, :i] @ (vectors[:, :i].T @ vectors[:, i])
            vectors[:, i] /= np.linalg.norm(vectors[:, i])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[:wanted], vectors[:, :wanted]
