"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitexture.session import discard, stored


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, both bigint): the
    smallest node of its component.

    Large and small stars in turn: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows. Each round is two joins of
    the link table, which never grows, and the number of rounds grows with the
    logarithm of the nodes. Every round is written to the shared folder.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _tally(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(edges)
        discard(large)
        edges, after = small, _tally(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
