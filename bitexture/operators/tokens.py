"""Word counts, vocabularies and id sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.functions.arrays import BOS_ID, EOS_ID, MAX_LEN, UNK_ID

# --- fixed values ---------------------------------------------------------
SPECIAL_TOKENS = (
    "[PAD]",
    "[UNK]",
    "[BOS]",
    "[EOS]",
    "__src_en__",
    "__tgt_vi__",
    "__tgt_ja__",
    "__tgt_zh__",
)
VOCAB_SIZE = 32_000
# Words and punctuation runs; Java reads \w in the Unicode sense with (?U).
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"


def pretokenize(c: Column, specials: Sequence[str] = ()) -> Column:
    """Array of words and punctuation runs. ``specials`` are kept whole
    wherever they occur, also inside a word."""
    if not specials:
        return F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0))
    alternatives = "|".join(_quote(s) for s in specials)
    pattern = rf"(?U){alternatives}|(?:(?!{alternatives})\w)+|(?:(?!{alternatives})[^\w\s])+"
    # looking ahead at every character is for texts that hold one
    held = reduce(or_, [c.contains(s) for s in specials])
    return F.when(held, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(pretokenize(c))


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in text)


def word_freq(texts: DataFrame, column: str = "text") -> DataFrame:
    """``token, n`` over all texts; counts are combined before the shuffle, so
    a frequent word costs one row per task."""
    return (
        texts.select(F.explode(pretokenize(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def build_vocab(words: DataFrame, size: int = VOCAB_SIZE, specials: Sequence[str] = SPECIAL_TOKENS[:4]) -> DataFrame:
    """``token, id``: special tokens, then words by falling count (ties by
    token) until ``size`` entries. The size bounds the table."""
    spark = words.sparkSession
    room = size - len(specials)
    if room < 0:
        raise ValueError("vocabulary smaller than its special tokens")
    top = words.orderBy(F.desc("n"), "token").limit(room)
    w = Window.orderBy(F.desc("n"), "token")  # at most `size` rows
    ranked = top.select("token", (F.row_number().over(w) + (len(specials) - 1)).cast("int").alias("id"))
    head = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    return head.unionByName(ranked)


def vocab_rows(vocab: DataFrame, limit: int = 2_000_000) -> tuple[list[str], list[int]]:
    """The vocabulary on the driver, for a broadcast. Its size parameter keeps
    it small; a larger table is refused."""
    rows = vocab.select("token", "id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("vocabulary too large to broadcast")
    return [r.token for r in rows], [r.id for r in rows]


def vocab_ids(tokens: Column, vocab: DataFrame, unk: int = UNK_ID) -> Column:
    """Token arrays to id arrays, as a Column. The vocabulary is broadcast and
    whole Arrow batches are looked up at once, on the rows where they are: no
    token is shuffled."""
    shared = vocab.sparkSession.sparkContext.broadcast(vocab_rows(vocab))

    def look_up(batch: pa.Array) -> pa.Array:
        import pyarrow as arrow
        import pyarrow.compute as pc

        known, ids = (arrow.array(x) for x in shared.value)
        at = pc.index_in(batch.flatten(), value_set=known)
        found = pc.fill_null(pc.take(ids, at), unk).cast(arrow.int32())
        ends = pc.cumulative_sum(pc.fill_null(batch.value_lengths(), 0))
        offsets = arrow.concat_arrays([arrow.array([0], arrow.int32()), ends.cast(arrow.int32())])
        return arrow.ListArray.from_arrays(offsets, found)

    return F.arrow_udf(look_up, T.ArrayType(T.IntegerType()))(tokens)


def vocab_lookup(
    df: DataFrame, vocab: DataFrame, column: str = "tokens", name: str = "ids", unk: int = UNK_ID
) -> DataFrame:
    """Replaces a token array column by its ids; unknown tokens take ``unk``."""
    return df.withColumn(name, vocab_ids(F.coalesce(column, F.array().cast("array<string>")), vocab, unk)).drop(
        *([column] if column != name else [])
    )


def decode_ids(ids: Column, vocab: DataFrame, special_ids: Sequence[int] = ()) -> Column:
    """Id arrays to text, tokens joined by a blank. Ids in ``special_ids`` and
    ids outside the vocabulary are left out."""
    tokens, numbers = vocab_rows(vocab)
    skip = set(special_ids)
    kept = [(t, i) for t, i in zip(tokens, numbers) if i not in skip]
    shared = vocab.sparkSession.sparkContext.broadcast(([t for t, _ in kept], [i for _, i in kept]))

    def text(batch: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as pc

        names = arrow.array(shared.value[0], arrow.string())
        flat = batch.flatten()
        at = pc.index_in(flat, value_set=arrow.array(shared.value[1], flat.type))
        known = pc.is_valid(at)
        # known ids before each id, then before each row
        before = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        offsets = arrow.array(before[ends.astype("int64")].astype("int32"))
        rows = arrow.ListArray.from_arrays(offsets, names.take(at.filter(known)))
        joined = pc.binary_join(rows, " ")
        return pc.if_else(pc.is_valid(batch), joined, arrow.scalar(None, arrow.string()))

    return F.arrow_udf(text, T.StringType())(ids)


def decode_text(
    df: DataFrame, vocab: DataFrame, column: str = "ids", name: str = "text", special_ids: Sequence[int] = ()
) -> DataFrame:
    return df.withColumn(name, decode_ids(F.col(column), vocab, special_ids))


def symbol_pair_counts(
    words: DataFrame, symbols: str = "symbols", freq: str = "n", keys: Sequence[str] = (), lefts: str | None = None
) -> DataFrame:
    """``left, right, n``: adjacent symbol pairs weighted by word frequency,
    within ``keys`` if there are any. ``lefts`` names an array column: pairs that
    begin with one of its symbols are counted, all of these, and no others."""
    s = F.col(symbols)
    last = F.size(s) - 1
    pairs = F.arrays_zip(F.slice(s, F.lit(1), last).alias("left"), F.slice(s, F.lit(2), last).alias("right"))
    opened = words.where(F.size(s) > 1).select(*keys, F.inline(pairs), F.col(freq).alias("__n"), *([lefts] if lefts else []))
    return (
        (opened.where(F.array_contains(lefts, F.col("left"))) if lefts else opened)
        .groupBy(*keys, "left", "right")
        .agg(F.sum("__n").alias("n"))
    )


def token_length_stats(df: DataFrame, ids: str = "ids", limit: int = MAX_LEN) -> DataFrame:
    """Per language: rows, mean length, rows cut at ``limit`` and their share,
    median and 95th percentile of the length. The percentiles are exact: they
    keep one count per distinct length."""
    size = F.size(ids)
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(size).alias("mean_len"),
        F.max(size).cast("bigint").alias("max_len"),
        F.count_if(size > limit).alias("n_cut"),
        F.avg((size > limit).cast("int")).alias("share_cut"),
        F.percentile(size, F.lit(0.5)).alias("p50_len"),
        F.percentile(size, F.lit(0.95)).alias("p95_len"),
    )


def bigram_scores(
    ids: DataFrame, column: str = "ids", digits: int = 6, keys: Sequence[str] = (), after: str | None = None
) -> DataFrame:
    """``prev, next, n, logprob`` from adjacent ids between begin and end
    markers, counted within ``keys`` if there are any; ``logprob`` is rounded so
    that sums do not depend on order. ``after`` names an array column: scores of
    what follows one of its ids, for callers that need no others."""
    seq = F.concat(F.array(F.lit(BOS_ID)), F.col(column), F.array(F.lit(EOS_ID)))
    rows = ids.select(*keys, seq.alias("symbols"), F.lit(1).cast("bigint").alias("n"), *([after] if after else []))
    counts = symbol_pair_counts(rows, keys=keys, lefts=after)
    w = Window.partitionBy(*keys, "left")  # at most one row per vocabulary entry
    return counts.select(
        *keys,
        F.col("left").alias("prev"),
        F.col("right").alias("next"),
        "n",
        F.round(F.log(F.col("n") / F.sum("n").over(w)), digits).alias("logprob"),
    )
