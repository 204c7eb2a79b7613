"""Translation requests over a translation memory.

``memory``: ``src_lang, tgt_lang, src, tgt``, one row per sentence and
direction. A missing sentence has no translation and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.functions import predicates as P
from bitexture.functions import text as X
from bitexture.operators.lookup import lookup_join
from bitexture.session import stored

MODEL_NAME = "Transformer"


def check_requests(
    df: DataFrame, languages: Sequence[str] = P.LISTED_LANGUAGES, english: str = "Tiếng Anh"
) -> DataFrame:
    """Stateless part, for batch and streams alike: adds ``status``,
    ``detail``, the normalized ``source`` and ``pivot``."""
    status, detail = P.validate_request(F.col("source_text"), F.col("source_lang"), F.col("target_lang"), languages)
    source = X.strip_unicode(F.coalesce("source_text", F.lit("")))
    direct = P.direct_pairs(languages, english)
    return df.withColumns(
        {
            "status": status,
            "detail": detail,
            "source": X.normalize_english(source, F.col("source_lang"), english),
            "pivot": (status == 200) & P.use_pivot(F.col("source_lang"), F.col("target_lang"), direct),
        }
    )


def clean_memory(memory: DataFrame) -> DataFrame:
    """Targets tidied once per entry instead of once per use."""
    return memory.withColumn("tgt", X.clean_output(F.col("tgt")))


def translate_documents(docs: DataFrame, memory: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` (``key, src_lang, tgt_lang, text``) translated sentence by
    sentence: adds ``translated``, the found parts in order, joined by a blank.

    ``memory`` must be unique per direction and sentence and already tidied.
    Sentences repeated across documents are salted in the lookup.
    """
    return docs.join(_translated(docs, memory, key, []), key)


def _translated(docs, memory, key, carry):
    """``key, *carry, translated``: columns of ``carry`` go along with the
    sentences, which saves a join with the documents."""
    sentences = docs.select(
        key, *carry, "src_lang", "tgt_lang", F.posexplode_outer(X.split_sentences(F.col("text"))).alias("pos", "src")
    )
    on = ["src_lang", "tgt_lang", "src"]
    hit = lookup_join(sentences, memory.select(*on, "tgt"), on, "left", spread=[key, "pos"])
    part = F.when(F.col("tgt") != "", F.struct("pos", "tgt"))
    parts = hit.groupBy(key, *carry).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["tgt"]), " ")
    return parts.select(key, *carry, text.alias("translated"))


def process_requests(
    df: DataFrame,
    memory: DataFrame,
    languages: Sequence[str] = P.LISTED_LANGUAGES,
    english: str = "Tiếng Anh",
    key: str = "req_id",
) -> DataFrame:
    """Whole request handling: validate, normalize, route, translate directly
    or over English, fill empty results, build the response."""
    checked = check_requests(df, languages, english)
    memory = stored(clean_memory(memory), "memory")  # read in both hops
    good = checked.where(F.col("status") == 200)
    # the first hop ends in the target language or in English
    first = _translated(
        good.select(
            key,
            "target_lang",
            "pivot",
            F.col("source_lang").alias("src_lang"),
            F.when(F.col("pivot"), F.lit(english)).otherwise(F.col("target_lang")).alias("tgt_lang"),
            F.col("source").alias("text"),
        ),
        memory,
        key,
        ["target_lang", "pivot"],
    )
    first = stored(first, "first-hop")  # read for its ends and for the second hop
    onward = first.where("pivot").select(
        key, F.lit(english).alias("src_lang"), F.col("target_lang").alias("tgt_lang"), F.col("translated").alias("text")
    )
    second = _translated(onward, memory, key, [])
    results = first.where(~F.col("pivot")).select(key, "translated").unionByName(second)
    out = checked.join(results, key, "left")
    ok = F.col("status") == 200
    return out.select(
        key,
        "source_lang",
        "target_lang",
        "status",
        "detail",
        F.when(ok, F.lit(MODEL_NAME)).alias("model"),
        "pivot",
        F.when(ok, X.placeholder_if_empty(F.col("translated"))).alias("translated_text"),
    )


def translate_batch(
    df: DataFrame, make_translator: Callable[[], Callable[[str], str]], column: str = "src", name: str = "hyp"
) -> DataFrame:
    """Applies a caller's text function to a column. ``make_translator`` is
    called once per task and batch stream, so a model loads once there."""

    def run(batches: Iterator) -> Iterator:
        translate = make_translator()
        for texts in batches:
            yield texts.map(translate, na_action="ignore")

    from collections.abc import Iterator as It

    import pandas as pd

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, T.StringType())(F.col(column)))


def resolve_same_language(df: DataFrame, options: Sequence[str]) -> DataFrame:
    """After the source language was picked: a target equal to it becomes the
    first other option."""
    fixed = P.resolve_same_language(F.col("source_lang"), F.col("target_lang"), options)
    return df.withColumn("target_lang", fixed)


def swap_languages(df: DataFrame, output: str = "output_text", ok: str = "output_ok") -> DataFrame:
    return df.withColumns(
        {
            "source_text": P.swapped_text(F.col("source_text"), F.col(output), F.col(ok)),
            "source_lang": F.col("target_lang"),
            "target_lang": F.col("source_lang"),
        }
    )
