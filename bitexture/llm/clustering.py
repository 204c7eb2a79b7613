"""Centroid clustering over blocks of a space-filling curve."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitexture.llm.vectors import floored, is_finite, matrix
from bitexture.session import discard, stored

#: Vectors of a block.
BLOCK_ROWS = 256
#: The curve runs through this many dimensions, those with the largest variance,
#: with so many bits each: 64 bits together.
CURVE_DIMS = 16
CURVE_BITS = 4
#: Entries as whole numbers are below; squared distances of 64 of them fit 63 bits.
MAX_ENTRY = 1 << 27
#: Centroids go to every task.
MAX_CLUSTERS = 4_096
#: Up to here products summed in double precision are exact.
_EXACT = 1 << 21


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (whole numbers of ``bits`` bits, at most 64
    bits a row) on the Hilbert curve, as a signed number in the same order."""
    x = cells.T.astype(np.uint64)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for axis in x:
            turned = (axis >> np.uint64(level) & one).astype(bool)
            swapped = np.where(turned, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swapped)
            axis ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> np.uint64(level) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flips
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | axis >> np.uint64(level) & one
    spare = 64 - bits * len(x)
    return (key << np.uint64(spare) ^ np.uint64(1 << 63)).view(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to a vector in each box (boxes x centroids).

    One centroid near the box's middle is held against every other: how much
    farther it can be within the box is a sum over the dimensions, each at one of
    the box's two sides. If it can't be farther anywhere, the other one is out;
    if it can be as far at most, the other one is out unless its number is smaller.
    """
    norms = (centroids * centroids).sum(1)
    middle = (low + high) // 2
    first = np.argmin(norms[None, :] - 2 * (middle @ centroids.T), axis=1)
    apart = centroids[first][:, None, :] - centroids[None, :, :]
    side = np.where(apart > 0, low[:, None, :], high[:, None, :])
    most = norms[first][:, None] - norms[None, :] - 2 * (apart * side).sum(2)
    numbers = np.arange(len(centroids))[None, :]
    kept = (most > 0) | ((most == 0) & (numbers < first[:, None]))
    kept[np.arange(len(first)), first] = True
    return kept


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row, the first of equally near ones,
    and its squared distance; exact."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT // max(1, rows.shape[1] // 64):
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        apart = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        apart = np.stack([((rows - c) ** 2).sum(1) for c in centroids], axis=1)
    at = apart.argmin(1)
    return at, apart[np.arange(len(at)), at].astype(np.int64)


def _blocks(ids: T.DataType, width: int) -> tuple[T.StructType, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """Blocks of consecutive rows with the smallest box around them."""
    schema = (
        T.StructType().add("__ids", T.ArrayType(ids)).add("__rows", T.BinaryType())
        .add("__low", T.ArrayType(T.LongType())).add("__high", T.ArrayType(T.LongType()))
    )
    names, kind = schema.fieldNames(), pa.list_(to_arrow_type(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            starts = np.arange(0, len(x), BLOCK_ROWS)
            if not len(starts):
                continue
            offsets = pa.array([*starts, len(x)], pa.int32())
            columns = [
                pa.ListArray.from_arrays(offsets, batch.column(0)).cast(kind),
                pa.array([x[a : a + BLOCK_ROWS].astype(np.int32).tobytes() for a in starts], pa.binary()),
                pa.array(list(np.minimum.reduceat(x, starts)), pa.list_(pa.int64())),
                pa.array(list(np.maximum.reduceat(x, starts)), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return schema, run


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: its place, its rows, their cluster and squared distance.
    ``at`` is the place of the rows' column; the sides of the boxes follow it."""
    width = centroids.shape[1]
    low, high = matrix(batch.column(at + 1), width), matrix(batch.column(at + 2), width)
    step = max(1, (1 << 22) // centroids.size)  # bounds the memory of the comparison
    for a in range(0, batch.num_rows, step):
        for i, kept in enumerate(candidates(low[a : a + step], high[a : a + step], centroids), a):
            rows = np.frombuffer(batch.column(at)[i].as_buffer(), np.int32).reshape(-1, width).astype(np.int64)
            numbers = np.flatnonzero(kept)
            place, distance = nearest(rows, centroids[numbers])
            yield i, rows, numbers[place], distance


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors;
    a centroid without vectors stays. Only sums leave the tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, rows, cluster, _ in _assigned(batch, centroids, 0):
                order = np.argsort(cluster, kind="stable")
                numbers, starts = np.unique(cluster[order], return_index=True)
                total[numbers] += np.add.reduceat(rows[order], starts)
                n += np.bincount(cluster, minlength=len(n))
        used = np.flatnonzero(n)
        columns = [
            pa.array(np.repeat(used, total.shape[1]), pa.int32()),
            pa.array(np.tile(np.arange(total.shape[1]), len(used)), pa.int32()),
            pa.array(np.repeat(n[used], total.shape[1]), pa.int64()),
            pa.array(total[used].ravel(), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "dim", "n", "s"])

    parts = blocks.select("__rows", "__low", "__high").mapInArrow(sums, "c int, dim int, n bigint, s bigint")
    out = centroids.copy()
    for c, dim, n, s in parts.groupBy("c", "dim").agg(F.sum("n"), F.sum("s")).collect():  # one row per centroid and dimension
        out[c, dim] = s // n
    return out


def cluster_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: str = "1"
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid`` of every
    vector with exactly ``width`` entries, none NULL or non-finite: its centroid
    after ``rounds`` rounds and the squared Euclidean distance to it, on entries
    turned into ``floor(scale * v)``.

    The centroids start as the ``clusters`` vectors with the smallest SHA-256 of
    ``<seed>:<key>`` in this order, and become the floored means of their vectors
    round by round; ties go to the smaller number.

    Vectors are dealt by their place on a Hilbert curve and kept in blocks with
    the box around each, written once to the shared folder. A round reads the
    blocks in place: bounds over a block's box leave it some centroids, and its
    vectors are compared with those only, exactly. No vector moves in a round,
    and only sums per centroid reach the driver. Places on the curve that many
    vectors share are dealt on by key and input partition.

    Other rows have no result. Rows that repeat a key are vectors of their own
    (of a repeated key the smallest vector is a start first); NULL keys take part,
    but never start a centroid. With fewer vectors with a key than ``clusters``
    there are fewer centroids, with none no rows. Entries of 2**27 or more after
    scaling are refused with an error. Other columns of ``table`` are not read.
    """
    if not 0 < clusters <= MAX_CLUSTERS or not 0 < width <= 4_096:
        raise ValueError(f"1 to {MAX_CLUSTERS} clusters, 1 to 4096 entries")
    limit = min(MAX_ENTRY, int((2**62 / width) ** 0.5 / 2))
    spark, ids = table.sparkSession, table.schema[key].dataType
    kept = table.where((F.size(vector) == width) & is_finite(F.col(vector))).select(
        F.col(key).alias("__id"), floored(F.col(vector), scale, limit).alias("__x")
    )
    out = T.StructType().add("__id", ids).add("cluster", T.IntegerType()).add("distance", T.LongType())
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")).cast("binary"), 256)
    starts = kept.where("__id IS NOT NULL").orderBy(place, "__x").limit(clusters).select("__x").collect()
    if not starts:
        nothing = spark.createDataFrame([], out).withColumnRenamed("__id", key)
        return nothing.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "CAST(array() AS ARRAY<BIGINT>) AS centroid")
    centroids = np.array([r[0] for r in starts], np.int64)

    middle, spread = _spread(kept, width)
    dims = np.argsort(-spread, kind="stable")[:CURVE_DIMS]

    @F.arrow_udf("bigint")
    def curve(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            # four standard deviations are sixteen cells
            x = (matrix(column, width)[:, dims] - middle[dims]) / np.maximum(spread[dims], 1e-9)
            half = 1 << (CURVE_BITS - 1)
            yield pa.array(hilbert_keys(np.clip(np.floor(x * half / 2) + half, 0, 2 * half - 1), CURVE_BITS), pa.int64())

    kind, block = _blocks(ids, width)
    order = ["__curve", "__salt", "__part"]
    placed = kept.withColumns(
        {"__curve": curve("__x"), "__salt": F.xxhash64("__id"), "__part": F.spark_partition_id()}
    )
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(dealt.select("__id", "__x").mapInArrow(block, kind), "blocks")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    id_kind = to_arrow_type(ids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, cluster, distance in _assigned(batch, centroids, 1):
                columns = [batch.column(0)[i].values.cast(id_kind), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    assigned = stored(blocks.mapInArrow(assign, out), "assigned")
    discard(blocks)
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per centroid
    rows = [(c, n, sum(inertia.values()), centroids[c].tolist()) for c, n in inertia.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(named), "cluster").select(
        F.col("__id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def _spread(kept: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each dimension, for the curve only."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += [np.full(width, len(x)), x.sum(0), (x * x).sum(0)]
        columns = [pa.array(np.arange(width), pa.int32()), *map(pa.array, total)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "s", "q"])

    parts = kept.select("__x").mapInArrow(sums, "dim int, n double, s double, q double")
    rows = parts.groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()  # one row per dimension
    _, n, s, q = np.array(sorted(rows)).T
    n = np.maximum(n, 1)
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
