"""Whole-number vectors from arrays of floating-point numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Neither NULL nor holding NULL, NaN or infinity."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def floored(vector: Column, scale: int, limit: int) -> Column:
    """``floor(scale * v)`` of each entry, in double precision, as bigint. Entries
    beyond ``limit`` are refused: sums of their products wouldn't be exact."""

    def entry(v: Column) -> Column:
        n = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) < limit, n).otherwise(
            F.raise_error(F.lit(f"a vector has an entry of {limit} / {scale} or more")).cast("bigint")
        )

    return F.transform(vector, entry)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` entries of a list column as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)
