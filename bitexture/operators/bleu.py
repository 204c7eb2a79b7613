"""N-gram counts and BLEU.

Hypothesis and reference of a sentence sit in one row, so its clipped matches
are counted inside the row: no n-gram is ever shuffled. Formula and smoothing
follow Papineni et al. 2002, Chen & Cherry 2014 and Post 2018.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.functions.scores import BLEU_ORDERS, bleu_from_counts
from bitexture.functions.text import WS, strip_unicode
from bitexture.session import stored

TOKENIZERS = ("none", "13a", "char")
#: Bytes of text whose n-grams a task holds at a time, or one row.
TEXT_BYTES = 1 << 20
#: Tokens whose n-grams are counted at a time, beside one longer row.
GRAM_TOKENS = 1 << 17


def bleu_text(c: Column, tokenizer: str = "13a") -> Column:
    """Text whose tokens are set apart by spaces: ``none`` (as it is), ``13a``
    (the mteval-v13a rules) or ``char`` (one token per character, for text
    without spaces)."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    if tokenizer == "char":
        return F.regexp_replace(c, f"([^{WS}])", "$1 ")
    if tokenizer == "13a":
        # --- fixed values: the public mteval-v13a rules ---
        c = F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
        c = F.translate(c, "\n", " ")
        for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        c = F.concat(F.lit(" "), c, F.lit(" "))
        c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
        c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
        c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
        c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return c


def bleu_tokens(c: Column, tokenizer: str = "13a") -> Column:
    return F.filter(F.split(strip_unicode(bleu_text(c, tokenizer)), f"[{WS}]+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by a blank, with repeats."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def _match_udf():
    orders = range(1, BLEU_ORDERS + 1)
    names = ["hyp_len", "ref_len", *[f"m{n}" for n in orders]]

    def count(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        """All rows at once: n-grams become numbers, a number per row and
        n-gram is counted on either side."""
        import numpy as np
        import pandas as pd
        import pyarrow as arrow
        import pyarrow.compute as pc

        size = len(hyps)
        texts = pc.fill_null(arrow.concat_arrays([hyps, refs]), "")
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        words = lists.flatten()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        # an empty text splits into one empty word
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(2 * size), lengths)[filled]
        lengths = np.bincount(owner, minlength=2 * size)
        word = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False)[filled].astype("int64")
        columns = [lengths[:size], lengths[size:]]
        gram, base = word, int(word.max(initial=0)) + 1
        for n in orders:
            if n > 1:
                # the shorter n-gram and the word that follows it
                gram = pd.factorize(gram[:-1] * base + word[n - 1 :])[0].astype("int64")
            inside = owner[: len(gram)] == owner[n - 1 : n - 1 + len(gram)]
            span = int(gram.max(initial=0)) + 1
            row = owner[: len(gram)][inside]
            item, keys = pd.factorize((row % size) * span + gram[inside])
            is_hyp = row < size
            in_hyp = np.bincount(item[is_hyp], minlength=len(keys))
            in_ref = np.bincount(item[~is_hyp], minlength=len(keys))
            clipped = np.minimum(in_hyp, in_ref)
            columns.append(np.bincount(keys // span, weights=clipped, minlength=size))
        return arrow.StructArray.from_arrays([arrow.array(c.astype("int64")) for c in columns], names)

    def matches(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        """Some rows at a time, so that memory doesn't grow with a batch's texts."""
        import numpy as np
        import pyarrow as arrow
        import pyarrow.compute as pc

        lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in (hyps, refs)]
        share = (np.cumsum(lengths[0] + lengths[1]) - 1) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(hyps)]
        parts = [count(hyps.slice(i, j - i), refs.slice(i, j - i)) for i, j in zip(cuts, cuts[1:])]
        return arrow.concat_arrays(parts)

    return F.arrow_udf(matches, T.StructType([T.StructField(c, T.LongType()) for c in names]))


def clipped_matches(hyp: Column, ref: Column) -> Column:
    """Struct of token counts ``hyp_len, ref_len`` and, per order, ``m1..m4``:
    the sum over distinct n-grams of ``min(count in hyp, count in ref)``, for
    two texts with tokens set apart by spaces. Counting inside the row saves a
    shuffle of eight n-grams per token."""
    return _match_udf()(hyp, ref)


def _gram_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Keys and token lists of at most ``GRAM_TOKENS`` tokens beside the longest
    row's, so that memory doesn't grow with a batch."""
    for batch in batches:
        keys, lists = batch.columns
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        share = (np.cumsum(sizes.astype(np.int64)) - 1) // GRAM_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield keys.slice(i, j - i), lists.slice(i, j - i)


def _row_grams(keys: pa.Array, lists: pa.ListArray, n: int) -> pa.RecordBatch:
    """``key, gram, n`` of some rows: tokens become numbers, a number per row
    and n-gram is counted; only the distinct n-grams of a row become text."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, tokens = np.repeat(np.arange(len(keys)), sizes), lists.flatten()
    coded = pc.dictionary_encode(tokens, null_encoding="encode")
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = max(len(word) - n + 1, 0)
    starts = np.flatnonzero(owner[:total] == owner[n - 1 : n - 1 + total])
    gram, base = word[starts], len(coded.dictionary) + 1
    for i in range(1, n):
        # the shorter n-gram and the word that follows it
        gram = np.unique(gram * base + word[starts + i], return_inverse=True)[1].astype(np.int64)
    span = int(gram.max(initial=0)) + 1
    _, first, counts = np.unique(owner[starts] * span + gram, return_index=True, return_counts=True)
    at = starts[first]
    parts = [coded.dictionary.take(pa.array(word[at + i])) for i in range(n)]
    texts = pc.binary_join_element_wise(*parts, " ", null_handling="skip") if n > 1 else parts[0]
    if n > 1 and (coded.dictionary.null_count or pc.any(pc.match_substring(coded.dictionary, " ")).as_py()):
        # n-grams of other tokens may read the same
        same = pc.dictionary_encode(texts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, group = np.unique(owner[at] * (len(texts) + 1) + same, return_index=True, return_inverse=True)
        counts = np.bincount(group, weights=counts, minlength=len(first))
        at, texts = at[first], texts.take(pa.array(first))
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(owner[at])), texts, pa.array(counts.astype(np.int64))], names=["key", "gram", "n"]
    )


def ngram_counts(df: DataFrame, n: int, key: str = "id", column: str = "tokens") -> DataFrame:
    """``key, gram, n``: how often each n-gram occurs in the rows of each key.

    Rows whose key is their own are counted where they are, many at a time, and
    neither their text nor an n-gram is shuffled. Which keys come again is found
    first, from the keys alone; only their rows' counts are added up by key and
    n-gram.
    """
    rows = df.select(key, column)
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1).select(key)
    again = stored(again, "repeated-keys")
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _gram_slices(batches):
            yield _row_grams(keys, lists, n).rename_columns([key, "gram", "n"])

    def counted(some: DataFrame) -> DataFrame:
        return some.mapInArrow(count, schema)

    if again.isEmpty():
        return counted(rows)
    # null-safe: a missing key is a key as well
    alias = again.withColumnRenamed(key, "__again")
    same = F.col(key).eqNullSafe(F.col("__again"))
    repeated = counted(rows.join(alias, same, "left_semi")).groupBy(key, "gram").agg(F.sum("n").alias("n"))
    return counted(rows.join(alias, same, "left_anti")).unionByName(repeated)


def bleu_stats(df: DataFrame, tokenizer: str = "13a", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Adds per-row lengths and, per order, matches ``m1..m4`` and totals
    ``t1..t4``."""
    texts = [bleu_text(F.col(c), tokenizer) for c in (hyp, ref)]
    counted = df.withColumn("__m", clipped_matches(*texts))
    out = {c: F.col(f"__m.{c}") for c in ("hyp_len", "ref_len")}
    for n in range(1, BLEU_ORDERS + 1):
        out[f"m{n}"] = F.col(f"__m.m{n}")
        out[f"t{n}"] = F.greatest(F.col("__m.hyp_len") - (n - 1), F.lit(0).cast("bigint"))
    return counted.withColumns(out).drop("__m")


def _parts() -> tuple[list[Column], list[Column]]:
    orders = range(1, BLEU_ORDERS + 1)
    return [F.col(f"m{n}") for n in orders], [F.col(f"t{n}") for n in orders]


def corpus_bleu(df: DataFrame, tokenizer: str = "13a") -> DataFrame:
    """One row: summed counts and the corpus score in percent."""
    return corpus_score(bleu_stats(df, tokenizer))


def corpus_score(stats: DataFrame) -> DataFrame:
    """``corpus_bleu`` from the counts of ``bleu_stats``."""
    names = ["hyp_len", "ref_len"] + [f"{k}{n}" for k in "mt" for n in range(1, BLEU_ORDERS + 1)]
    sums = stats.agg(*[F.sum(c).alias(c) for c in names])
    m, t = _parts()
    return sums.withColumn("bleu", bleu_from_counts(m, t, F.col("hyp_len"), F.col("ref_len")))


def sentence_bleu(df: DataFrame, tokenizer: str = "13a") -> DataFrame:
    """Adds ``score``, the BLEU of each row over its effective order."""
    return sentence_score(bleu_stats(df, tokenizer)).select(*df.columns, "score")


def sentence_score(stats: DataFrame) -> DataFrame:
    """``sentence_bleu`` from the counts of ``bleu_stats``."""
    m, t = _parts()
    score = bleu_from_counts(m, t, F.col("hyp_len"), F.col("ref_len"), effective_order=True)
    return stats.withColumn("score", score)


def best_sentences(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def worst_sentences(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy("score", "id").limit(k)
