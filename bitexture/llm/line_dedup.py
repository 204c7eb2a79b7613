"""Lines that many documents share, dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Without ASCII space at both ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {k for k in map(line_key, (text or "").encode().split(b"\n")) if _long_enough(k, min_chars)}
                ids.extend([doc] * len(keys))
                hashes.extend(map(_hash, keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(hashes, pa.binary())], names=["__doc", "__line"]
            )

    return run


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__doc, __line``: the hashes (128 bits) of each document's lines of at
    least ``min_chars`` code points, once each."""
    schema = T.StructType([T.StructField("__doc", docs.schema[key].dataType), T.StructField("__line", T.BinaryType())])
    texts = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).where(F.col("__doc").isNotNull())
    return texts.mapInArrow(_line_hashes(min_chars), schema).distinct()


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``__line, __last``: lines of at least ``min_docs`` documents, and the
    largest of these documents."""
    counted = lines.groupBy("__line").agg(F.count(F.lit(1)).alias("__n"), F.max("__doc").alias("__last"))
    return counted.where(F.col("__n") >= min_docs).select("__line", "__last")


def drop_shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Adds ``n_lines`` (before), ``n_dropped`` and ``kept`` (the text that is
    left). Lines are split at ``\\n``; a shared line stays in the largest
    document that has it, wherever it stands there.

    NULL and empty texts have one empty line and ``kept`` is empty. Rows with
    the same ``key`` count as one document, and a document without key is never
    counted and keeps its lines. Other columns pass through; the three added
    ones replace those of the input.
    """
    rest = docs.drop("n_lines", "n_dropped", "kept")
    lines = document_lines(rest, min_chars, key, text)
    frequent = shared_lines(lines, min_docs)
    gone = (
        lines.join(frequent, "__line")
        .where(F.col("__doc") != F.col("__last"))
        .groupBy("__doc")
        .agg(F.collect_set("__line").alias("__gone"))
    )

    @F.pandas_udf("kept string, n_dropped bigint")
    def cut(texts: pd.Series, gone_lines: pd.Series) -> pd.DataFrame:
        kept, dropped = [], []
        for body, gone in zip(texts, gone_lines):
            if body is None:
                kept.append(None)
                dropped.append(0)
                continue
            gone = {bytes(g) for g in gone}
            parts = body.encode().split(b"\n")
            stay = [p for p in parts if len(p) < min_chars or _hash(line_key(p)) not in gone]
            kept.append(b"\n".join(stay).decode())
            dropped.append(len(parts) - len(stay))
        return pd.DataFrame({"kept": kept, "n_dropped": dropped})

    body = F.coalesce(F.col(text), F.lit(""))
    joined = rest.join(gone, F.col(key) == F.col("__doc"), "left").withColumn(
        # only texts that lose lines go to Python
        "__cut", cut(F.when(F.col("__gone").isNotNull(), body), F.col("__gone"))
    )
    return (
        joined.withColumn("n_lines", (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("bigint"))
        .withColumn("n_dropped", F.col("__cut.n_dropped"))
        .withColumn("kept", F.coalesce(F.col("__cut.kept"), body))
        .drop("__doc", "__gone", "__cut")
    )
