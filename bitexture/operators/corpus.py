"""Sentence-pair corpus operators: caps, counts, directions, pivots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitexture.functions import predicates as P
from bitexture.functions import text as X
from bitexture.operators.lookup import lookup_join
from bitexture.operators.ranks import integer_levels, rank_cuts
from bitexture.session import stored


def clean_pairs(df: DataFrame) -> DataFrame:
    """Both sides cleaned; other columns stay.

    The cleaned sides go through a generator: a later filter on them then stays
    above it. Merged into one step, it would clean every text a second time.
    """
    rest = [c for c in df.columns if c not in ("src", "tgt")]
    clean = F.struct(*[X.preprocess_text(F.col(c)).alias(c) for c in ("src", "tgt")])
    return df.select(*rest, F.inline(F.array(clean)))


def valid() -> Column:
    return P.is_valid_pair(F.col("src"), F.col("tgt"))


def stripped_pairs(df: DataFrame) -> DataFrame:
    """Both sides without outer white space, otherwise as they are."""
    return df.withColumns({c: X.strip_unicode(F.coalesce(c, F.lit(""))) for c in ("src", "tgt")})


def non_empty() -> Column:
    return P.non_empty_pair(F.col("src"), F.col("tgt"))


def valid_pairs(df: DataFrame) -> DataFrame:
    """Cleaned valid pairs. Raw rows that cannot become valid go first."""
    return clean_pairs(df.where(P.maybe_valid_pair(F.col("src"), F.col("tgt")))).where(valid())


#: Languages of one table; each has limits of its own in the filters.
MAX_LANGUAGES = 1_000
_GROWTH = 4
_NO_LANGUAGE = "\0"


def _lines_between(spans: dict[str | None, tuple[int, int]]) -> Column:
    """Rows whose line is behind the first and up to the second number of its
    language: plain comparisons, which file statistics can answer."""
    out = F.lit(False)
    for lang, (after, upto) in spans.items():
        here = F.col("lang").isNull() if lang is None else F.col("lang") == lang
        out = out | (here & (F.col("line_no") > after) & (F.col("line_no") <= upto))
    return out


def _up_to_cap(df: DataFrame, cap: int, clean: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """Rows read until the cap-th kept one of their language, cleaned, with
    ``__ok`` where they are kept.

    One pass over languages and line numbers says how dense the lines of each
    language are. Then a prefix of each language is read and cleaned that should
    hold the cap; where it doesn't, the lines behind it follow, four times as
    many. No row is cleaned twice, the limits are literals that reach the scan,
    and what lies behind the cap is not read.
    """
    base = df.where(F.col("line_no").isNotNull())
    found = base.groupBy("lang").agg(F.count(F.lit(1)), F.min("line_no"), F.max("line_no")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    nothing = clean(base.where(F.lit(False))).withColumn("__ok", keep)
    if cap <= 0 or not found:
        return nothing
    last, spans, kept = {}, {}, {}
    for lang, n, low, high in found:
        reach = min(1.0, 1.5 * cap / n)
        last[lang], kept[lang] = high, 0
        spans[lang] = (low - 1, high if reach == 1 else low + int((high - low) * reach))
    first = {lang: after for lang, (after, _) in spans.items()}
    parts = []
    while spans:
        part = stored(clean(base.where(_lines_between(spans))).withColumn("__ok", keep), "prefix")
        parts.append(part)
        for lang, n in part.where("__ok").groupBy("lang").count().collect():  # one row per language
            kept[lang] += n
        spans = {
            lang: (upto, min(last[lang], upto + _GROWTH * (upto - first[lang])))
            for lang, (_, upto) in spans.items()
            if kept[lang] < cap and upto < last[lang]
        }
    prefix = union_languages(*parts)
    full = [lang for lang, n in kept.items() if n >= cap]
    if not full:
        return prefix
    named = prefix.where("__ok").select(F.coalesce("lang", F.lit(_NO_LANGUAGE)).alias("lang"), "line_no")
    cuts = rank_cuts(named, ["lang"], ["line_no"], integer_levels("line_no"), F.array(F.lit(cap)))
    # one row per language
    stops = {None if r.lang == _NO_LANGUAGE else r.lang: r.cut.line_no for r in cuts.collect()}
    return prefix.where(_lines_between({lang: (first[lang], stops.get(lang, last[lang])) for lang in first}))


def cap_per_language(
    df: DataFrame, cap: int, clean: Callable[[DataFrame], DataFrame] = clean_pairs, keep: Column | None = None
) -> DataFrame:
    """The first ``cap`` valid pairs of each language in line order, cleaned.

    The caller's own ``clean`` (which must keep ``lang`` and ``line_no``) and
    ``keep``, a condition on its result, may replace cleaning and validity:
    ``clean=stripped_pairs, keep=non_empty()`` keeps all that is not empty. The
    cap is turned into a last line number per language, so pairs are filtered,
    never sorted or shuffled. ``line_no`` must be unique per language; rows
    without one are left out.
    """
    return _up_to_cap(df, cap, clean, valid() if keep is None else keep).where("__ok").drop("__ok")


def load_stats(
    df: DataFrame, cap: int, clean: Callable[[DataFrame], DataFrame] = clean_pairs, keep: Column | None = None
) -> DataFrame:
    """``lang, raw, valid, skipped`` over the rows read until the cap stopped
    the load; later rows are not counted."""
    return (
        _up_to_cap(df, cap, clean, valid() if keep is None else keep)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("raw"),
            F.count_if("__ok").alias("valid"),
            F.count_if(~F.col("__ok")).alias("skipped"),
        )
    )


def pair_summary(df: DataFrame) -> DataFrame:
    """Pairs per language and in total (``lang`` is ``TOTAL``)."""
    return (
        df.rollup("lang")
        .agg(F.count(F.lit(1)).alias("pairs"), F.grouping("lang").alias("__all"))
        .select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("lang")).alias("lang"), "pairs")
    )


def union_languages(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def both_directions(
    df: DataFrame, tags: dict[str, str] | None = None, english_tag: str = X.ENGLISH_TAG
) -> DataFrame:
    """Each pair twice, tagged with the language it goes to: forth as
    ``direction`` 0 and back as 1. One pass, no union of two scans."""
    src, tgt = X.untab(F.col("src")), X.untab(F.col("tgt"))
    forth = F.struct(
        F.lit(0).alias("direction"),
        F.concat(X.tag_for(F.col("lang"), tags), F.lit(" "), src).alias("src"),
        tgt.alias("tgt"),
    )
    back = F.struct(
        F.lit(1).alias("direction"),
        F.concat(F.lit(english_tag + " "), tgt).alias("src"),
        src.alias("tgt"),
    )
    rest = [c for c in df.columns if c not in ("src", "tgt")]
    return df.select(*rest, F.explode(F.array(forth, back)).alias("p")).select(*rest, "p.*")


def tagged_line() -> Column:
    return F.concat("src", F.lit("\t"), "tgt")


def translation_memory(pairs: DataFrame) -> DataFrame:
    """One target per ``lang, src`` (the smallest), so a lookup is a function.
    Copies collapse map-side before the shuffle."""
    return pairs.groupBy("lang", "src").agg(F.min("tgt").alias("tgt"))


def pivot_pairs(to_english: DataFrame, from_english: DataFrame) -> DataFrame:
    """Two hops over English: ``(src_lang, text, english)`` composed with
    ``(tgt_lang, english, translation)``.

    Both hops are functions (the smallest value per key), so a source text
    gets one result per target language and an English sentence shared by many
    texts cannot multiply rows; its rows are salted.
    """
    key = X.preprocess_text(F.col("english"))
    hop1 = to_english.groupBy("src_lang", "text").agg(F.min(key).alias("english"))
    per_lang = (
        from_english.select("tgt_lang", key.alias("english"), "translation")
        .groupBy("english", "tgt_lang")
        .agg(F.min("translation").alias("translation"))
    )
    # as many entries as there are target languages
    hop2 = per_lang.groupBy("english").agg(
        F.collect_list(F.struct("tgt_lang", "translation")).alias("targets")
    )
    return (
        lookup_join(hop1, hop2, ["english"], "inner", spread=["src_lang", "text"])
        .select("src_lang", "text", "english", F.inline("targets"))
        .where(F.col("src_lang") != F.col("tgt_lang"))
    )
