"""Positions, running sums and rank cut-offs without a big sort in one task.

A plain ``row_number()`` over a language or a whole table sends all of it to
one task. Here the order is split into *levels*: columns that grow with the
order, coarse to fine. Counts per level are small tables; their running sums
give every finest bucket its start, and only inside one bucket are rows ever
sorted. Two ready-made level lists keep buckets small whatever the data hold:

* ``integer_levels`` for an integer that is unique within its keys: a bucket
  spans 2**16 values, so it has at most 65 536 rows, and each coarser level has
  at most 65 536 buckets per parent;
* ``hash_levels`` for an md5 of a unique key: buckets are uniform.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitexture.session import checkpointed

_TAKEN = "__taken"


def integer_levels(order: str) -> list[Column]:
    c = F.col(order).cast("bigint")
    return [F.shiftright(c, 48), F.shiftright(c, 32), F.shiftright(c, 16)]


def hash_levels(order: str) -> list[Column]:
    """For a hex digest: 4 096 buckets, then 4 096 in each of them."""
    return [F.substring(order, 1, 3), F.substring(order, 1, 6)]


def shuffle_key(seed: str, *key: str) -> Column:
    """Pseudo-random order that depends on seed and key only, so it is the same
    under any partitioning and after any task retry."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Adds inclusive running sums, taken in ``order`` within ``keys``.

    ``order`` must be unique within ``keys`` and not NULL. The input is read
    twice: once for the bucket table, aggregated map-side and written once for
    its uses, and once for the rows, which are shuffled by bucket.
    """
    keys = list(keys)
    names = [f"__l{i}" for i in range(len(levels))]
    before = {n: f"__before_{n}" for n in sums}
    tagged = df
    for name, level in zip(names, levels):
        tagged = tagged.withColumn(name, level)
    finest = checkpointed(tagged.groupBy(*keys, *names).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))

    starts = None
    for depth in range(len(names)):
        group, child = keys + names[:depth], names[depth]
        table = finest
        if depth < len(names) - 1:
            table = finest.groupBy(*group, child).agg(*[F.sum(n).alias(n) for n in sums])
        w = Window.partitionBy(*group) if group else Window.partitionBy()
        w = w.orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
        table = table.select(
            *group, child, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before[n]) for n in sums]
        )
        if starts is not None:
            parent = starts.select(*group, *[F.col(before[n]).alias(f"__up_{n}") for n in sums])
            table = table.join(parent, group).select(
                *group, child, *[(F.col(before[n]) + F.col(f"__up_{n}")).alias(before[n]) for n in sums]
            )
        starts = table

    inner = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(starts, keys + names)
    return joined.select(
        *df.columns, *[(F.col(before[n]) + F.sum(e).over(inner)).alias(n) for n, e in sums.items()]
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: Sequence[Column], name: str
) -> DataFrame:
    """Adds the 0-based position in ``order`` within ``keys``."""
    out = running_sums(df, keys, order, levels, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def rank_cuts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Column],
    targets: Column,
    where: Column | None = None,
) -> DataFrame:
    """Order values at given 1-based ranks, per key: ``keys, total,
    target, cut``.

    ``targets`` is an array of ranks, computed from ``__total`` (rows of the
    key). ``cut`` is a struct of the ``order`` columns; ranks outside
    ``1..__total`` give no row. No row of ``df`` is shuffled but those of the
    crossing buckets: the input is read once for the bucket counts and once
    for those buckets. ``where`` (rows that count) is applied after the bucket
    test in the second read, so a costly condition runs on few rows there.

    ``keys`` must have few distinct values (languages, say): the result and
    the bucket list have a handful of rows per key and are broadcast.
    """
    keys = list(keys)
    names = [f"__l{i}" for i in range(len(levels))]
    tagged = df
    for name, level in zip(names, levels):
        tagged = tagged.withColumn(name, level)
    counted = tagged if where is None else tagged.where(where)
    # a small table that is read once per level; written once, so that the
    # input is not counted again for each of them
    finest = checkpointed(counted.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n")))
    picked = None
    for depth in range(len(names)):
        group, child = keys + names[:depth], names[depth]
        table = finest
        if depth < len(names) - 1:
            table = finest.groupBy(*group, child).agg(F.sum("__n").alias("__n"))
        if depth:
            # the children of the buckets chosen so far, once per target
            table = table.join(F.broadcast(picked), group)
            group = group + ["target"]
        w = Window.partitionBy(*group)
        upto = F.sum("__n").over(w.orderBy(child).rowsBetween(Window.unboundedPreceding, 0))
        if depth == 0:
            total = F.sum("__n").over(w)
            table = table.select(*group, child, "__n", upto.alias("__upto"), total.alias("__total"))
            inside = F.filter(
                F.array_distinct(targets.cast("array<bigint>")),
                lambda t: (t > F.col("__upto") - F.col("__n")) & (t <= F.col("__upto")),
            )
            table = table.withColumn("target", F.explode(inside)).withColumn(_TAKEN, F.lit(0))
        else:
            rank = F.col("target") - F.col(_TAKEN)
            table = table.withColumn("__upto", upto)
            table = table.where((rank > F.col("__upto") - F.col("__n")) & (rank <= F.col("__upto")))
        picked = table.select(
            *keys, *names[: depth + 1], "target", "__total", (F.col(_TAKEN) + F.col("__upto") - F.col("__n")).alias(_TAKEN)
        )
    near = tagged.join(F.broadcast(picked), keys + names)
    if where is not None:
        # tied to the join, so it is not evaluated before it
        near = near.where(F.when(F.col("target").isNotNull(), where))
    w = Window.partitionBy(*keys, *names, "target").orderBy(*order)
    ranked = near.withColumn("__rn", F.row_number().over(w))
    return ranked.where(F.col("__rn") == F.col("target") - F.col(_TAKEN)).select(
        *keys, F.col("__total").alias("total"), "target", F.struct(*[F.col(o) for o in order]).alias("cut")
    )
