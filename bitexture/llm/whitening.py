"""Whitening of embeddings on their largest principal components."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitexture.llm.feast import largest_eigenpairs
from bitexture.llm.vectors import floored, is_finite, matrix
from bitexture.session import discard, stored

#: The covariance of so many dimensions goes to the driver.
MAX_DIMS = 1_024
#: Entries as whole numbers are below.
MAX_ENTRY = 1 << 40
_CHUNK = 2_048
_HALF = 1 << 20
_EXACT = T.DecimalType(38, 0)


class Sums(NamedTuple):
    """Rows of the fit list, and what each dimension sums up to."""

    n: int
    total: list[int]

    def middle(self) -> np.ndarray:
        """The whole number next to the mean of each dimension."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.total], np.int64)

    def rest(self) -> list[int]:
        """Sums after the middle is taken from every row."""
        return [s - self.n * int(m) for s, m in zip(self.total, self.middle())]


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def dimension_sums(fit: DataFrame, width: int) -> Sums:
    """Exact sums; one row per task and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            n += len(x)
            total = [t + s for t, s in zip(total, x.sum(0).tolist())]
        columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), _decimals(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "s"])

    schema = T.StructType().add("dim", T.IntegerType()).add("n", T.LongType()).add("s", _EXACT)
    parts = fit.mapInArrow(run, schema).groupBy("dim").agg(F.sum("n"), F.sum("s"))
    rows = sorted(parts.collect())  # one row per dimension
    return Sums(rows[0][1], [int(s) for _, _, s in rows])


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers below 2**41 as Python numbers. Products of
    halves of the digits, in chunks, are exact in double precision."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), _CHUNK):
        part = y[at : at + _CHUNK]
        upper = (part + _HALF // 2) // _HALF
        a, b = upper.astype(np.float64), (part - upper * _HALF).astype(np.float64)
        out += (b.T @ b).astype(np.int64)
        if upper.any():
            ab = (a.T @ b).astype(np.int64).astype(object)
            out += (ab + ab.T) * _HALF + (a.T @ a).astype(np.int64).astype(object) * (_HALF * _HALF)
    return out


def covariance(fit: DataFrame, width: int, sums: Sums) -> tuple[np.ndarray, float]:
    """Covariance (divisor n) of the fit list and its trace. Rows are centred on
    the whole number next to the mean before they are multiplied; the rest is
    taken off exactly, so that every entry is rounded once."""
    middle = sums.middle()
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            total += exact_products(matrix(batch.column(0), width) - middle)
        columns = [pa.array(upper[0] * width + upper[1], pa.int32()), _decimals(total[upper].tolist())]
        yield pa.RecordBatch.from_arrays(columns, names=["pair", "s"])

    schema = T.StructType().add("pair", T.IntegerType()).add("s", _EXACT)
    rows = fit.mapInArrow(run, schema).groupBy("pair").agg(F.sum("s")).collect()  # one row per pair of dimensions
    n, rest = sums.n, sums.rest()
    out, trace = np.zeros((width, width)), 0
    for pair, s in rows:
        i, j = divmod(pair, width)
        exact = n * int(s) - rest[i] * rest[j]
        out[i, j] = out[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    return out, trace / (n * n)


class Whitener:
    """Maps whole-number rows to deviations and whitened components."""

    def __init__(self, sums: Sums, values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.middle = sums.n, sums.middle()
        self.rest = np.array(sums.rest(), dtype=object)
        self.project = vectors / np.sqrt(values)[None, :]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sum`` of each dimension."""
        y = x - self.middle
        if (int(np.abs(y).max(initial=0)) + 1) * self.n < 2**62:
            return y * self.n - self.rest.astype(np.int64)
        return y.astype(object) * self.n - self.rest

    def __call__(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        u = self.deviations(x)
        small = u.dtype != object and (int(np.abs(u).max(initial=0)) + 1) ** 2 * u.shape[1] < 2**63
        squares = (u * u if small else u.astype(object) ** 2).sum(1)
        return squares.tolist(), (u / self.n).astype(np.float64) @ self.project


def identity_error(fit: DataFrame, width: int, whiten: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance without the identity."""
    k = whiten.project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            _, z = whiten(matrix(batch.column(0), width))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["pair", "s"])

    rows = fit.mapInArrow(run, "pair int, s double").groupBy("pair").agg(F.sum("s")).collect()  # one row per pair of components
    return max(abs(s / whiten.n - (pair // k == pair % k)) for pair, s in rows)


def whiten_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for
    every row with a vector and the ``components`` largest principal components,
    numbered from 1.

    Entries are ``floor(scale * v) + offset``. The fit list holds each distinct
    vector once: ``n`` vectors with sums S. Sums and products are exact whole
    numbers from Spark; the driver gets the covariance (at most 1 024
    dimensions) and takes its largest eigenvalues ``e`` and unit eigenvectors by
    contour integration, checked by inertia counts. ``deviation`` is the exact
    sum of ``(n * x - S) ** 2`` (decimal), ``whitened`` the projection of
    ``x - S / n`` over ``sqrt(e)``, ``explained`` is ``e`` over the trace, and
    ``identity_error`` the largest entry of the whitened fit list's covariance
    without the identity.

    Rows with a NULL or empty vector, or one with a NULL or non-finite entry,
    have no result; nor have rows whose vectors aren't of the most frequent
    length (the longer one of equally frequent). Repeated rows and NULL keys have
    results like any other. Components without variance are left out, so there
    are no rows for an empty table or for one distinct vector only. Equal
    eigenvalues have some orthonormal vectors of their space. Entries of 2**40
    or more after scaling are refused with an error. Other columns aren't read.
    """
    ids = table.schema[key].dataType
    whole = table.where(is_finite(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key).alias("__id"), F.col(vector).alias("__v"))
    lengths = whole.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = lengths[0] if lengths else 1
    if width > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} entries")
    rows = whole.where(F.size("__v") == width).select(
        "__id", F.transform(floored(F.col("__v"), scale, MAX_ENTRY), lambda v: v + offset).alias("__x")
    )
    values, vectors, trace, error = np.zeros(0), np.zeros((width, 0)), 0.0, 0.0
    sums = Sums(1, [0] * width)
    if lengths:
        fit = stored(rows.select("__x").distinct(), "fit")
        sums = dimension_sums(fit, width)
        matrix_, trace = covariance(fit, width, sums)
        values, vectors = largest_eigenpairs(matrix_, components)
        if len(values):
            error = identity_error(fit, width, Whitener(sums, values, vectors))
        discard(fit)
    if not len(values):
        rows, values, vectors, trace = rows.limit(0), np.ones(1), np.zeros((width, 1)), 1.0
    whiten, kind = Whitener(sums, values, vectors), to_arrow_type(ids)
    schema = T.StructType().add("__id", ids).add("deviation", _EXACT).add("__z", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                squares, z = whiten(matrix(part.column(1), width))
                columns = [part.column(0).cast(kind), _decimals(squares), pa.array(list(z), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    each = rows.mapInArrow(run, schema).select("__id", "deviation", F.posexplode("__z").alias("__at", "whitened"))
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    return each.select(
        F.col("__id").alias(key),
        (F.col("__at") + 1).alias("component"),
        F.lit(sums.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("__at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
