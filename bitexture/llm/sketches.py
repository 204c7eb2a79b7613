"""Bottom-k sketches of shingle hashes, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SIZE = 128
#: Rows of one run of neighbouring keys that stay together: 2 ** RUN_BITS.
RUN_BITS = 6
_LEVEL_BITS = 16


def text_words(text: Column) -> Column:
    """Words between ASCII white space, in lower case."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """64-bit hashes of all runs of ``width`` words; a shorter text is one run,
    an empty one has none."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)),
        lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(width)]),
    )
    return (
        F.when(F.size(words) >= width, runs)
        .when(F.size(words) > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def bottom_k(hashes: Column, size: int = SIZE) -> Column:
    """The ``size`` smallest distinct hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, size)


def text_sketch(text: Column, size: int = SIZE, width: int = WORDS) -> Column:
    # the words are computed once, as the only element of an array
    return F.get(F.transform(F.array(text_words(text)), lambda w: bottom_k(shingle_hashes(w, width), size)), F.lit(0))


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, size: int = SIZE) -> DataFrame:
    """Sketch of the union of all parts of each key. Only the smallest ``size``
    hashes count, so hashes are first made distinct, then ranked by key and a
    slice of the hash, then by key."""
    hashes = df.select(*keys, F.explode(sketch).alias("__h")).distinct()
    spread = Window.partitionBy(*keys, F.pmod("__h", F.lit(64))).orderBy("__h")
    few = hashes.withColumn("__r", F.row_number().over(spread)).where(F.col("__r") <= size)
    return few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("__h")), 1, size).alias(sketch))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated |A and B| / |A or B|: of the smallest hashes of the union, the
    share that both have. Two empty sketches are alike."""
    union = merged(a, b, size)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles, exact below ``size``."""
    span = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / span)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated |A and B| / |A|, from the resemblance and the counts."""
    union = distinct_shingles(merged(a, b, size), size)
    share = resemblance(a, b, size) * union / distinct_shingles(a, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def sketch_documents(docs: DataFrame, size: int = SIZE, width: int = WORDS, text: str = "text") -> DataFrame:
    """Adds ``sketch`` (array of hashes) and ``n_shingles`` (estimate) to each
    row. NULL, empty and blank texts have an empty sketch."""
    out = docs.drop("sketch", "n_shingles").withColumn("sketch", text_sketch(F.col(text), size, width))
    return out.withColumn("n_shingles", distinct_shingles(F.col("sketch"), size))


def _next_first(firsts: DataFrame, depth: int = 0) -> DataFrame:
    """``run, next``: the first key of the next run that has rows (of the first
    run for the last), from ``run, first``. Runs are grouped by their upper bits,
    and groups are followed in the same way, so no window has more than
    2 ** 16 rows."""
    if depth == 4:
        # of 64 bits only the sign is left: two rows at most
        w = Window.partitionBy(F.lit(1)).orderBy("run")
        return firsts.select("run", F.coalesce(F.lead("first").over(w), F.first("first").over(w)).alias("next"))
    group = F.shiftright(F.col("run"), _LEVEL_BITS)
    inside = firsts.withColumn("group", group).withColumn(
        "next", F.lead("first").over(Window.partitionBy("group").orderBy("run"))
    )
    groups = inside.groupBy("group").agg(F.min("first").alias("first")).withColumnRenamed("group", "run")
    after = _next_first(groups, depth + 1).select(F.col("run").alias("group"), F.col("next").alias("after"))
    return inside.join(after, "group").select("run", F.coalesce("next", "after").alias("next"))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row with the next larger integer key (of
    the smallest key for the last row).

    Rows are sorted within runs of 64 key values, so ids may be dense or
    sparse. Only the last row of a run looks further, at the first row of
    the next run that has any. Rows without key come before all others; equal
    keys follow one another in no fixed order. Input columns of the added names
    are replaced.
    """
    run = F.coalesce(F.shiftright(F.col(key).cast("bigint"), RUN_BITS), F.lit(-(2**62)))
    tagged = docs.withColumn("__run", run)
    w = Window.partitionBy("__run").orderBy(key)
    following = {c: f"next_{c}" for c in columns}
    docs, tagged = docs.drop(*following.values()), tagged.drop(*following.values())
    inside = tagged.withColumn("__row", F.row_number().over(w)).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    for c, n in following.items():
        inside = inside.withColumn(n, F.lead(c).over(w))
    heads = inside.where("__row = 1").select(F.col("__run").alias("__to"), *[F.col(c).alias(f"__{c}") for c in columns])
    runs = docs.select(run.alias("run")).distinct().withColumn("first", F.col("run"))
    order = _next_first(runs).withColumnRenamed("next", "__to")
    # the head of a run goes back to the run before it
    back = order.join(heads, "__to").select(F.col("run").alias("__run"), *[f"__{c}" for c in columns])
    out = inside.join(back, "__run", "left")
    return out.select(
        *docs.columns, *[F.when(F.col("__last"), F.col(f"__{c}")).otherwise(F.col(n)).alias(n) for c, n in following.items()]
    )


def fingerprint_text(sketch: Column) -> Column:
    """The hashes in hex, joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
