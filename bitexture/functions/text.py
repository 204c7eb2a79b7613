"""Text functions, all ``Column -> Column``.

Everything is built-in Spark except two Arrow UDFs, Unicode composition and
the full HTML entity table. Both get NULL for the rows that cannot change, so
Python only ever sees the rows that need it; of entities it sees no other text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
# Unicode whitespace as Python's str.strip() knows it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a Java character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters, digits and underscore: Python's word characters.
WORD = r"\p{L}\p{N}_"
# General categories Cc and Cf without TAB and LF.
CONTROL = (
    r"\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891"
    r"\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff"
    r"\ufff9-\ufffb\x{110bd}\x{110cd}\x{13430}-\x{1343f}\x{1bca0}-\x{1bca3}"
    r"\x{1d173}-\x{1d17a}\x{e0001}\x{e0020}-\x{e007f}"
)
# Code points that NFC neither changes nor composes with a neighbour: Latin
# below the combining marks, Cyrillic letters, precomposed Vietnamese, general
# punctuation, kana, Han, Hangul syllables and full-width forms.
NFC_STABLE = (
    r"\x00-\u02ff\u0400-\u0482\u1e00-\u1eff\u2002-\u206f\u2190-\u21ff"
    r"\u3000-\u3029\u3041-\u3096\u309b-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffee"
)
QUOTES = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u00ab": '"',
    "\u00bb": '"',
}
DASHES = "\u2012\u2013\u2014\u2015"
LANGUAGE_TAGS = {"vi": "<2vi>", "ja": "<2ja>", "zh": "<2zh>"}
ENGLISH_TAG = "<2en>"
NO_TRANSLATION = "[Không thể dịch]"
CHAR_LIMIT = 500
# Entities the basic decoder knows; the ampersand goes last.
BASIC_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&amp;": "&",
}


def _nfc_udf():
    def compose(texts):
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(compose, T.StringType())


#: A character reference as ``html.unescape`` finds it.
_CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _unescape_udf():
    """Lists of character references to lists of what they stand for; each
    distinct one of a batch is looked up once."""

    def unescape(batch: pa.Array) -> pa.Array:
        import html

        import pyarrow as arrow
        import pyarrow.compute as pc

        coded = pc.dictionary_encode(batch.flatten())
        plain = arrow.array([html.unescape(r) for r in coded.dictionary.to_pylist()], arrow.string())
        ends = pc.cumulative_sum(pc.fill_null(batch.value_lengths(), 0))
        offsets = arrow.concat_arrays([arrow.array([0], arrow.int32()), ends.cast(arrow.int32())])
        return arrow.ListArray.from_arrays(offsets, plain.take(coded.indices))

    return F.arrow_udf(unescape, T.ArrayType(T.StringType()))


def nfc(c: Column) -> Column:
    """Unicode NFC. Only text with a code point outside the stable set is sent
    to Python; every other row enters the UDF as NULL and keeps its value."""
    suspect = F.when(c.rlike(f"[^{NFC_STABLE}]"), c)
    return F.coalesce(_nfc_udf()(suspect), c)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, f"[{CONTROL}]", "")


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


def ascii_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks and tabs become one blank; line feeds stay."""
    return F.regexp_replace(F.translate(c, "\t", " "), " {2,}", " ")


def strip_unicode(c: Column) -> Column:
    """Strip every Unicode space; Spark's ``trim`` alone removes U+0020 only."""
    return F.btrim(c, F.lit(WHITESPACE))


def preprocess_text(c: Column) -> Column:
    """Full cleaning: NULL or empty gives ``""``. One scan tells whether the
    text holds anything the inner steps change; most text does not."""
    composed = nfc(F.coalesce(c, F.lit("")))
    # one pass for quotes, dashes and tabs
    plain = F.translate(
        strip_control(composed),
        "".join(QUOTES) + DASHES + "\t",
        "".join(QUOTES.values()) + "-" * len(DASHES) + " ",
    )
    plain = F.regexp_replace(plain, " {2,}", " ")
    suspect = c.rlike(f"[{CONTROL}{''.join(QUOTES)}{DASHES}\t]| {{2}}")
    return strip_unicode(F.when(suspect, plain).otherwise(composed))


def untab(c: Column) -> Column:
    return F.translate(c, "\t", " ")


def flatten_newlines(c: Column) -> Column:
    """Keeps one record on one line: line breaks become a blank."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def tag_for(lang: Column, tags: dict[str, str] | None = None, default: str | None = None) -> Column:
    """Tag of a language. An unknown language takes ``default``; without a
    default it is an error, as a missing dictionary key is."""
    tags = LANGUAGE_TAGS if tags is None else tags
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    if default is None:
        missing = F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(lang, F.lit("NULL"))))
        missing = missing.cast("string")
    else:
        missing = F.lit(default)
    return F.coalesce(F.element_at(table, lang), missing)


def tag_source(
    c: Column, lang: Column, tags: dict[str, str] | None = None, default: str | None = None
) -> Column:
    return F.concat(tag_for(lang, tags, default), F.lit(" "), c)


def join_spaced_entities(c: Column) -> Column:
    """``& apos ;`` becomes ``&apos;``."""
    return F.regexp_replace(c, f"& ([{WORD}]+) ;", "&$1;")


def html_unescape(c: Column, full: bool = True) -> Column:
    """HTML entities to characters: the whole HTML5 table, or the basic six
    without leaving the JVM."""
    if full:
        # Python sees the references only, whatever the length of the texts
        found = _unescape_udf()(F.when(c.contains("&"), F.regexp_extract_all(c, F.lit(_CHARREF), F.lit(0))))
        parts = F.zip_with(F.split(c, _CHARREF), found, lambda part, char: F.concat(part, F.coalesce(char, F.lit(""))))
        return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(c)
    for entity, char in BASIC_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unspace_punct(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+([.,!?;:'\"])", "$1")


def unspace_open_bracket(c: Column) -> Column:
    return F.regexp_replace(c, rf"([\[(])[{WS}]+", "$1")


def collapse_double_space(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def clean_output(c: Column, full: bool = True) -> Column:
    """Tidies machine output: entities, spaces around punctuation, ends."""
    c = html_unescape(join_spaced_entities(c), full)
    c = unspace_open_bracket(unspace_punct(c))
    return strip_unicode(collapse_double_space(c))


def split_sentences(c: Column) -> Column:
    """Sentences of a text: cut after ``. ! ?`` plus space, or at line feeds."""
    parts = F.split(strip_unicode(c), rf"(?<=[.!?])[{WS}]+|\n+")
    return F.filter(F.transform(parts, strip_unicode), lambda s: s != "")


def normalize_english(c: Column, lang: Column, english: str = "en") -> Column:
    """English only: the lone word ``i`` and the first letter in upper case."""
    fixed = F.regexp_replace(c, f"(?<![{WORD}])i(?![{WORD}])", "I")
    fixed = F.concat(F.upper(F.substring(fixed, 1, 1)), F.substr(fixed, F.lit(2)))
    return F.when(lang == english, fixed).otherwise(c)


def placeholder_if_empty(c: Column, text: str = NO_TRANSLATION) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(text)).otherwise(c)


_WIDE = r"\x{10000}-\x{10FFFF}"


def char_count(c: Column) -> Column:
    """Length in UTF-16 units, as a page counts its input: a sign beyond the
    basic plane counts twice."""
    wide = F.when(c.rlike(f"[{_WIDE}]"), F.length(F.regexp_replace(c, f"[^{_WIDE}]", ""))).otherwise(0)
    return (F.length(c) + wide).cast("bigint")


def over_limit(c: Column, limit: int = CHAR_LIMIT) -> Column:
    return char_count(c) > limit


def epoch_from_name(c: Column, prefix: str = "transformer_ep", suffix: str = ".pt") -> Column:
    """Epoch number inside an artifact name; 0 when it does not parse."""
    name = F.element_at(F.split(c, "/"), -1)
    digits = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
