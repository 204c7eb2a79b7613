"""Positions in a seeded order, without one window over a whole source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_SOURCE = "\x00none"
_BUCKET_BITS = 12


def seeded_key(seed: str, *columns: str) -> Column:
    """64-bit hash of the seed and the columns (NULL counts as a value)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NO_SOURCE)) for c in columns]
    return F.xxhash64(F.lit(seed), *parts)


def source_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_SOURCE))


def starts_of(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``counts`` (``keys, bucket, __n``) with the rows before each bucket
    (``__start``) and of the whole key (``__total``)."""
    w = Window.partitionBy(*keys)
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys,
        bucket,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(w).alias("__total"),
    )


def hashed_positions(df: DataFrame, key: str, order: str, ties: list[Column], name: str, total: str) -> DataFrame:
    """Adds the 0-based position (``name``) of each row in the order of the
    64-bit hash ``order`` within ``key``, and the rows of the key (``total``).

    The hash is cut into 4 096 even buckets per key, so a key that holds most
    rows is spread over all tasks; only rows of one bucket are sorted together.
    """
    tagged = df.withColumn("__bucket", F.shiftrightunsigned(F.col(order), 64 - _BUCKET_BITS))
    counts = tagged.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    inner = Window.partitionBy(key, "__bucket").orderBy(order, *ties)
    ranked = tagged.withColumn("__in", F.row_number().over(inner) - 1)
    return (
        ranked.join(starts_of(counts, [key], "__bucket"), [key, "__bucket"])
        .withColumn(name, F.col("__start") + F.col("__in"))
        .withColumn(total, F.col("__total"))
        .drop("__bucket", "__in", "__start", "__total")
    )
