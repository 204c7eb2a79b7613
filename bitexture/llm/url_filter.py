"""Blocked Bloom filter of listed URLs, checked by an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitexture.operators.lookup import lookup_join

#: Bits of filter per listed URL; a block is one 64-bit word.
BITS_PER_URL = 16
BITS_SET = 5
#: Filters up to this size are broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 1 << 20
#: Rules are tried on each row; a longer table is refused.
INLINE_RULES = 256


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:(?:(?!://).)*)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:(?:(?!://).)*)://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """``host/path?query`` without scheme, user, ``www.``, default port, fragment,
    tracking parameters, ``index.html`` and the last slash."""
    host = F.regexp_replace(url_host(url), r"^(?:[^@]*@)?(?:www\.)?", "")
    host = F.regexp_replace(host, r":(?:80|443)?$", "")
    path = F.regexp_replace(url_path(url), r"(?:/index\.html?)?/*$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#?]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(?:utm_[^=]*|gclid|fbclid|ref)(?:=|$)") & (p != ""))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))


def _word(c: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), c), F.lit(words).cast("bigint"))


def _mask(c: Column) -> Column:
    """Bits of a URL in its word, six bits of one hash for each."""
    h = F.xxhash64(F.lit("bits"), c)
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(BITS_SET)
    ]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocked_bloom(listed: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """The filter's non-zero words (``word, bits``) and their number. Filters of
    parts with as many words merge by OR."""
    canon = listed.select(canonical_url(F.col(url)).alias("c"))
    words = max(1, canon.count() * BITS_PER_URL // 64)
    table = (
        canon.select(_word(F.col("c"), words).alias("word"), _mask(F.col("c")).alias("m"))
        .groupBy("word")
        .agg(F.bit_or("m").alias("bits"))
    )
    return table, words


def listed_urls(rows: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``canonical`` and ``listed`` (is the canonical URL that of a listed
    one?) to every row.

    URLs that the blocked Bloom filter rules out are not listed; the others
    are joined with the list itself, which removes false positives. The filter
    is broadcast up to ``BROADCAST_WORDS`` words, else joined by shuffle.
    A NULL URL has an empty canonical URL and is never listed, nor are empty ones.
    """
    words, size = blocked_bloom(listed.where(F.col(url).isNotNull()), url)
    words = words.withColumnsRenamed({"word": "__word", "bits": "__bits"})
    exact = listed.select(canonical_url(F.col(url)).alias("__c")).where("__c <> ''").distinct()
    probe = (
        rows.drop("canonical", "listed")
        .withColumn("canonical", canonical_url(F.col(url)))
        .withColumn("__word", _word(F.col("canonical"), size))
        .withColumn("__mask", _mask(F.col("canonical")))
    )
    words = F.broadcast(words) if size <= BROADCAST_WORDS else words
    passed = probe.join(words, "__word", "left").withColumn(
        "__maybe", F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    )
    # only possible hits are joined, and dealt by URL; the others stay where they are
    some, none = passed.where("__maybe"), passed.where(~F.col("__maybe"))
    hits = lookup_join(some, exact.select(F.col("__c").alias("canonical"), F.lit(True).alias("__hit")), ["canonical"], "left", spread=[url])
    helpers = ("__word", "__mask", "__bits", "__maybe", "__hit")
    found = hits.withColumn("listed", F.coalesce("__hit", F.lit(False))).drop(*helpers)
    return found.unionByName(none.withColumn("listed", F.lit(False)).drop(*helpers))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fit, as a struct
    ``n, rule, verdict``. A rule fits its host and all subdomains where the path
    starts with its own. Ties go to the last by name."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        ok = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = rule_host + rule_path
        fits.append(
            F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    if not fits:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def judge_urls(
    rows: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url: str = "url"
) -> DataFrame:
    """Adds ``host, path, rule, verdict, canonical, listed``: the verdict of the
    longest fitting rule, else ``block`` for listed URLs and ``allow`` for others.

    NULL URLs and URLs without ``://`` have an empty host and path, fit no
    rule and are allowed. All rows stay, repeated ones too. At most
    ``INLINE_RULES`` rules are taken; a longer table belongs in ``listed``.
    """
    if len(rules) > INLINE_RULES:
        raise ValueError(f"more than {INLINE_RULES} rules")
    out = listed_urls(rows.drop("host", "path", "rule", "verdict"), listed, url)
    out = out.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    out = out.withColumn("__r", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return (
        out.withColumn("rule", F.col("__r.rule")).withColumn("verdict", F.coalesce(F.col("__r.verdict"), method)).drop("__r")
    )
