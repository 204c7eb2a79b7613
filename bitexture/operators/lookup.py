"""Joins: set membership, line alignment and skew-safe lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is split, and rows of one part.
MIN_HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, on: Sequence[str], min_rows: int) -> DataFrame:
    """Hashes of the frequent keys and the parts each is split into. Every key
    with ``min_rows`` rows is listed, so there are at most rows / min_rows.
    Counting by hash keeps the shuffle at two numbers per distinct key; a hash
    clash only changes where rows go."""
    return (
        df.groupBy(F.xxhash64(*on).alias("__h"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_rows)
        .select("__h", (F.ceil(2 * F.col("__n") / min_rows)).cast("int").alias("__parts"))
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] = (),
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Joins a fact side to a lookup side that is unique per key.

    Keys that fill many rows of ``left`` are split into parts of about half of
    ``min_rows``: their rows go to a part chosen by a hash of the ``spread``
    columns, and the one lookup row is copied to each. Every other key is
    joined as usual, so nothing is dropped, and only the hot keys' lookup rows
    are repeated.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(left, on, min_rows))  # at most rows / min_rows rows
    spread = list(spread) or left.columns
    parts = F.col("__parts")
    salt = F.when(parts.isNotNull(), F.pmod(F.xxhash64(*spread), parts)).otherwise(F.lit(0))
    copies = F.when(parts.isNotNull(), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    l = left.withColumn("__h", F.xxhash64(*on)).join(hot, "__h", "left")
    l = l.withColumn("__salt", salt.cast("int")).drop("__h", "__parts")
    r = right.withColumn("__h", F.xxhash64(*on)).join(hot, "__h", "left")
    r = r.withColumn("__salt", F.explode(copies)).drop("__h", "__parts")
    return l.join(r, [*on, "__salt"], how).drop("__salt")


def in_set(df: DataFrame, members: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` are one of the listed tuples (a semi join; the
    list comes from the caller's code, so its size is that of the code)."""
    return df.join(F.broadcast(_member_table(df, members, columns)), list(columns), "left_semi")


def not_in_set(df: DataFrame, members: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    return df.join(F.broadcast(_member_table(df, members, columns)), list(columns), "left_anti")


def _member_table(df, members, columns):
    schema = df.select(*columns).schema
    return df.sparkSession.createDataFrame([tuple(m) for m in members], schema)


def zip_lines(a: DataFrame, b: DataFrame, number: str = "line_no") -> DataFrame:
    """Positional zip of two numbered line tables; stops at the shorter one."""
    return a.join(b, number)


def zip_eval(hyps: DataFrame, refs: DataFrame, key: str = "id") -> DataFrame:
    """Hypotheses next to their references."""
    return hyps.join(refs, key)
