"""Shards that match the mixture: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitexture.llm.order import hashed_positions, seeded_key, source_key

#: Rows of one bucket of fractions, which are sorted together.
BUCKET_ROWS = 5_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def stratified_shards(
    docs: DataFrame, shards: int = 8, seed: str = "shards", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within
    a shard) to every row.

    Rows of a source are put in a seeded random order; row ``r`` of ``n`` gets
    the fraction ``(r + 1/2) / n``. All rows sorted by fraction interleave the
    sources in proportion, and equal cuts of that order give shards whose row
    counts differ by one at most and whose mixture is that of the whole.

    A NULL source is a source of its own; NULL and repeated keys are ordinary
    rows (among equal keys the order is open); an empty table gives an empty
    table. Other columns pass through; columns ``shard`` and ``slot`` of the
    input are replaced.
    """
    base = docs.drop("shard", "slot").withColumn("__src", source_key(source)).withColumn("__h", seeded_key(seed, key))
    rows = docs.count()
    buckets = F.lit(max(1, rows // BUCKET_ROWS)).cast("bigint")
    ranked = hashed_positions(base, "__src", "__h", [F.col(key)], "__rank", "__of")
    # the bucket of the fraction, in whole numbers
    placed = ranked.withColumn("__cut", _div((2 * F.col("__rank") + 1) * buckets, 2 * F.col("__of")))
    # the rows of a source before a bucket follow from its size
    sizes = base.groupBy("__src").agg(F.count(F.lit(1)).alias("__of"))
    edges = sizes.withColumn("__cut", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1)))
    before = _div(2 * F.col("__of") * F.col("__cut") + buckets - 1, 2 * buckets)
    starts = edges.groupBy("__cut").agg(F.sum(before).alias("__start"))
    inner = Window.partitionBy("__cut").orderBy((2 * F.col("__rank") + 1) / F.col("__of"), "__src", "__h", key)
    place = F.col("__start") + F.row_number().over(inner) - 1
    n, k = F.lit(max(rows, 1)), F.lit(shards).cast("bigint")
    shard = _div(F.col("__pos") * k, n)
    return (
        placed.join(starts, "__cut")
        .withColumn("__pos", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("__pos") - _div(F.col("shard") * n + k - 1, k))
        .drop("__src", "__h", "__rank", "__of", "__cut", "__start", "__pos")
    )
