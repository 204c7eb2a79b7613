"""Benchmark items inside documents: size-partitioned MinHash containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.llm.shingles import Shingler
from bitexture.session import stored

WORDS = 5
CONTAINMENT = 0.8
#: MinHash functions. One shared minimum makes a candidate (bands of one row).
HASHES = 32
#: Benchmarks of up to so many items send their minima to every task; those of a
#: larger one are joined by shuffle.
BROADCAST_ITEMS = 200_000
_ROWS = 1 << 14
_U = np.uint64
LONGS = T.ArrayType(T.LongType())

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_STEPS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def size_class(n: int) -> int:
    """Items of ``2 ** c`` up to ``2 ** (c + 1) - 1`` shingles are class c."""
    return max(n, 1).bit_length() - 1


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions."""
    return np.min(_mixed(hashes), axis=0) if len(hashes) else np.zeros(0, np.uint64)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    return hashes[:, None] * _FACTORS[None, :] + _STEPS[None, :]


def window_minima(hashes: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Per size class the minima of all windows (rows).

    A class-c item has up to ``2 ** (c + 1)`` shingles. Windows span twice that
    and start at every such step, so a passage lies whole in one of them, and
    the window is at most four times the item: with containment 0.8 the
    resemblance is at least 0.8 / 4.2, whatever the length of the document.
    """
    n = len(hashes)
    if not n:
        return
    width = 2 << min(classes)
    step = max(1, _ROWS // width) * width
    parts = []
    for at in range(0, n, step):
        part = _mixed(hashes[at : at + step])
        parts.append(np.minimum.reduceat(part, np.arange(0, len(part), width), axis=0))
    blocks = np.concatenate(parts)
    for c in range(min(classes), max(classes) + 1):
        if c in classes:
            yield c, np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
        if len(blocks) > 1:  # pairs of blocks for the next class
            even = blocks[: len(blocks) // 2 * 2]
            paired = np.minimum(even[0::2], even[1::2])
            blocks = np.concatenate([paired, blocks[-1:]]) if len(blocks) % 2 else paired


def keys_of(signature: np.ndarray, c: int) -> np.ndarray:
    """One 64-bit key for each minimum, its function and size class."""
    place = np.arange(HASHES, dtype=np.uint64) + _U(c * HASHES + 1)
    return signature ^ (place * _U(0xD6E8FEB86659FD93))


def item_table(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, width, shingles`` (distinct hashes) ``, c, keys`` of every item that
    has words. ``width`` is the number of words of a shingle: five, or all of an
    item that has fewer; such an item is one shingle and needs no minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(WORDS)
        for batch in batches:
            words = [shingle.words(t.as_py()) for t in batch.column(1)]
            widths = [min(len(w), WORDS) for w in words]
            hashes = [np.unique(Shingler(k).runs(w)) for k, w in zip(widths, words)]
            classes = [size_class(len(h)) for h in hashes]
            keys = [keys_of(minima(h), c).view(np.int64) if k == WORDS else [] for h, c, k in zip(hashes, classes, widths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(widths, pa.int32()), pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64())),
                 pa.array(classes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["item", "width", "shingles", "c", "keys"],
            )

    kind = T.StructType().add("item", items.schema[key].dataType).add("width", T.IntegerType())
    kind = kind.add("shingles", LONGS).add("c", T.IntegerType()).add("keys", LONGS)
    return items.select(F.col(key), F.col(text)).mapInArrow(run, kind).where(F.size("shingles") > 0)


def _short_hits(table: dict[int, np.ndarray]):
    """``doc, key``: the short items' shingles that a document has. Tasks get
    the sorted hashes of the items by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        shingle = Shingler(WORDS)
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                words = shingle.words(t.as_py())
                found = [np.intersect1d(Shingler(k).runs(words), h) for k, h in known.items() if len(words) >= k]
                keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
                if len(keys):
                    doc = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(keys.view(np.int64))], names=["doc", "key"])

    return run


def _all_short(widths: list[int]):
    """Every shingle of these widths of every document, for the shuffle join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(WORDS)
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                words = shingle.words(t.as_py())
                keys = np.unique(np.concatenate([Shingler(k).runs(words) for k in widths if len(words) >= k] or [words[:0]]))
                if len(keys):
                    doc = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(keys.view(np.int64))], names=["doc", "key"])

    return run


def _short_items(source: DataFrame, table: DataFrame, broadcast_items: int, doc_type: T.DataType) -> DataFrame | None:
    """``doc, item, n_shared, n_item`` for the items with fewer than five words,
    which a document has whole or not at all."""
    short = table.where(F.col("width") < WORDS).select("item", "width", F.col("shingles")[0].alias("key"))
    n, widths = short.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("width"))).first()
    if not n:
        return None
    pair = T.StructType().add("doc", doc_type).add("key", T.LongType())
    if n <= broadcast_items:
        by_width = {k: [] for k in widths}
        for r in short.select("width", "key").collect():
            by_width[r.width].append(r.key)
        sent = {k: np.unique(np.array(v, np.int64).view(np.uint64)) for k, v in by_width.items()}
        hits = source.mapInArrow(_short_hits(source.sparkSession.sparkContext.broadcast(sent)), pair)
    else:
        hits = source.mapInArrow(_all_short(widths), pair)
    one = F.lit(1)
    return hits.join(short, "key").select("doc", "item", one.alias("n_shared"), one.alias("n_item"))


def _hits(table: tuple[list[int], np.ndarray, np.ndarray, list], schema: pa.Schema):
    """Documents with candidate items, and their distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, keys, owner, names = table.value
        size = 1 << max(16, int(len(keys) * 16).bit_length())
        maybe = np.zeros(size, bool)
        maybe[keys & _U(size - 1)] = True
        shingle = Shingler()
        for batch in batches:
            ids, found, sets = [], [], []
            for i, t in enumerate(batch.column(1)):
                hashes = shingle(t.as_py())
                mine: set[int] = set()
                for c, signature in window_minima(hashes, classes):
                    k = keys_of(signature, c).ravel()
                    k = k[maybe[k & _U(size - 1)]]
                    if len(k):
                        k = np.unique(k)
                        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                        for a, b in zip(low[high > low], high[high > low]):
                            mine.update(owner[a:b].tolist())
                if mine:
                    ids.append(i)
                    found.append([names[m] for m in sorted(mine)])
                    sets.append(np.unique(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(found, schema.field("items").type),
                 pa.array(sets, pa.list_(pa.int64()))],
                names=["doc", "items", "shingles"],
            )

    return run


def _all_keys(classes: list[int]):
    """Every window key of every document, for the shuffle join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                hashes = shingle(t.as_py())
                keys = [keys_of(s, c).ravel() for c, s in window_minima(hashes, classes)]
                if keys:
                    keys = np.unique(np.concatenate(keys)).view(np.int64)
                    doc = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(keys)], names=["doc", "key"])

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [np.unique(shingle(t.as_py())).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "shingles"])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = CONTAINMENT,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    broadcast_items: int = BROADCAST_ITEMS,
) -> DataFrame:
    """``doc_key, item_key, n_shared, n_item, containment``: the items of which
    at least ``threshold`` of the five-word shingles are in the document.

    Items are partitioned by size; long documents are searched by windows of
    the size that fits each class. A window and an item that share one of 32
    minima are candidates: with containment 0.8 within a window one is missed
    in 1 000 times at most. Candidates are then compared shingle by shingle with
    the whole document, so no pair below the threshold comes through. Items of
    one to four words are searched as one run of that many words, exactly. NULL
    and empty texts contain nothing; items without words are in nothing. Every
    item is searched, those with a NULL or repeated id as well; a result row names
    a document and an item id, with the highest containment among equal ones.
    Documents without key are left out of the result, as they can't be named.
    """
    # numbers are given once, as the table is written
    named = item_table(items, item_key, item_text).withColumnRenamed("item", "name").withColumn("item", F.monotonically_increasing_id())
    table = stored(named, "items")
    long = table.where(F.col("width") == WORDS)
    n, classes = long.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("c"))).first()
    source = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
    spark, doc_type = docs.sparkSession, docs.schema[doc_key].dataType
    out = T.StructType().add("doc", doc_type).add("items", LONGS).add("shingles", LONGS)
    if n == 0:
        found = spark.createDataFrame([], T.StructType().add("doc", doc_type).add("item", T.LongType()).add("shingles", LONGS))
    elif n <= broadcast_items:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = long.select("item", "keys").collect()
        keys = np.array([k for r in rows for k in r["keys"]], np.int64).view(np.uint64)
        owner = np.repeat(np.arange(len(rows)), HASHES)
        order = np.argsort(keys, kind="stable")
        sent = spark.sparkContext.broadcast((classes, keys[order], owner[order], [r["item"] for r in rows]))
        hits = source.mapInArrow(_hits(sent, to_arrow_schema(out)), out)
        found = hits.select("doc", F.explode("items").alias("item"), "shingles")
    else:
        pair = T.StructType().add("doc", doc_type).add("key", T.LongType())
        probes = source.mapInArrow(_all_keys(classes), pair)
        item_keys = long.select("item", F.explode("keys").alias("key"))
        pairs = probes.join(item_keys, "key").select("doc", "item").distinct()
        sets = T.StructType().add("doc", doc_type).add("shingles", LONGS)
        found = pairs.join(source.mapInArrow(_shingle_sets, sets), "doc").select("doc", "item", "shingles")
    exact = found.join(long.select("item", F.col("shingles").alias("mine")), "item")
    shared = F.size(F.array_intersect("mine", "shingles"))
    scored = exact.select("doc", "item", shared.alias("n_shared"), F.size("mine").alias("n_item"))
    scored = scored.where(F.col("n_shared") / F.col("n_item") >= threshold)
    short = _short_items(source, table, broadcast_items, doc_type)
    if short is not None:
        scored = scored.unionByName(short)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b")
    once = scored.join(table.select("item", "name"), "item").groupBy("doc", "name").agg(best)
    return once.select(F.col("doc").alias(doc_key), F.col("name").alias(item_key), "b.n_shared", "b.n_item", "b.containment")
