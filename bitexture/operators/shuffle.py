"""Reproducible shuffles, splits and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitexture.operators.ranks import hash_levels, integer_levels, rank_cuts, row_index, shuffle_key

RATIOS = (0.85, 0.10, 0.05)
SPLITS = ("train", "val", "test")
BATCH = 64


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: str = "42") -> DataFrame:
    """Rows in a pseudo-random order fixed by ``seed`` and the unique ``key``.
    The sort key is uniform, so the range partitions of the sort are even."""
    return df.orderBy(shuffle_key(seed, *key), *key)


def epoch_seed(seed: str, epoch: int) -> str:
    return f"{seed}/{epoch}"


def epoch_shuffle(df: DataFrame, key: Sequence[str], epoch: int, seed: str = "42") -> DataFrame:
    """A new order for each epoch, for training rows."""
    return seeded_shuffle(df, key, epoch_seed(seed, epoch))


def shuffled_index(df: DataFrame, key: Sequence[str], seed: str = "42", name: str = "row_idx") -> DataFrame:
    """Adds the 0-based position a row has after ``seeded_shuffle``."""
    hashed = df.withColumn("__md5", shuffle_key(seed, *key))
    out = row_index(hashed, [], ["__md5", *key], hash_levels("__md5"), name)
    return out.drop("__md5")


def assign_batches(df: DataFrame, index: str = "row_idx", size: int = BATCH) -> DataFrame:
    """Consecutive batches of ``size`` rows; the last one may be short."""
    return df.withColumn("batch_id", F.floor(F.col(index) / size).cast("bigint"))


def file_order_index(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """Adds the 0-based position by a unique integer column (file order)."""
    return row_index(df, [], [order], integer_levels(order), name)


def first_batch(df: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """The first ``size`` rows; each task hands over no more than these."""
    return df.orderBy(order).limit(size)


def check_ratios(ratios: Sequence[float]) -> None:
    if abs(round(sum(ratios), 6) - 1.0) > 1e-5:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios):.4f}")


def split_exact(
    df: DataFrame,
    key: Sequence[str],
    ratios: Sequence[float] = RATIOS,
    seed: str = "42",
    group: Sequence[str] = (),
) -> DataFrame:
    """Adds ``split``: exact sizes ``floor(n * train)``, ``floor(n * val)`` and
    the rest for test, in shuffled order.

    The two border rows are found from bucket counts, then each row compares
    its own hash with the borders: no row is sorted or shuffled. With
    ``group`` whole groups go to one split and sizes count groups.
    """
    check_ratios(ratios)
    unit = list(group) or list(key)
    hashed = df.withColumn("__md5", shuffle_key(seed, *unit))
    units = hashed.select(*unit, "__md5")
    if group:
        units = units.distinct()
    order = ["__md5", *unit]

    def sizes(total: Column) -> tuple[Column, Column]:
        n = total.cast("double")
        n_train = F.floor(n * F.lit(ratios[0]))
        return n_train, n_train + F.floor(n * F.lit(ratios[1]))

    targets = F.array(*sizes(F.col("__total")))
    cuts = rank_cuts(units, [], order, hash_levels("__md5"), targets)
    n_train, n_both = sizes(F.col("total"))
    # one row: the last position of train, and of train with val
    border = cuts.agg(
        F.struct(
            F.max(F.when(F.col("target") == n_train, F.col("cut"))).alias("train"),
            F.max(F.when(F.col("target") == n_both, F.col("cut"))).alias("val"),
        ).alias("b")
    ).scalar()
    here = F.struct(*[F.col(o) for o in order])
    return hashed.withColumn(
        "split",
        F.when(here <= border["train"], SPLITS[0]).when(here <= border["val"], SPLITS[1]).otherwise(SPLITS[2]),
    ).drop("__md5")


def split_hash(
    df: DataFrame,
    key: Sequence[str],
    ratios: Sequence[float] = RATIOS,
    seed: str = "42",
    group: Sequence[str] = (),
) -> DataFrame:
    """Adds ``split`` by hash alone: sizes are approximate, one narrow pass.
    With ``group`` all rows of a group fall together."""
    check_ratios(ratios)
    digest = shuffle_key(seed, *(group or key))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    return df.withColumn(
        "split",
        F.when(u < ratios[0], SPLITS[0]).when(u < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]),
    )


def split_summary(df: DataFrame, batch: int = BATCH) -> DataFrame:
    """Rows and batches per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.ceil(F.count(F.lit(1)) / batch).cast("bigint").alias("n_batches"),
    )
