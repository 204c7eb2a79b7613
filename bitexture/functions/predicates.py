"""Row predicates for sentence pairs, lines and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitexture.functions.text import strip_unicode, WS

MIN_CHARS = 3
MAX_CHARS = 500

# --- fixed values: languages of the request form, in its option order -----
REQUEST_LANGUAGES = {
    "Tiếng Anh": "en",
    "Tiếng Việt": "vi",
    "Tiếng Nhật": "ja",
    "Tiếng Trung": "zh",
}
# the order in which an error lists them
LISTED_LANGUAGES = ("Tiếng Việt", "Tiếng Nhật", "Tiếng Trung", "Tiếng Anh")
EMPTY_TEXT = "source_text không được để trống."
BAD_SOURCE = "source_lang không hợp lệ: "
BAD_TARGET = "target_lang không hợp lệ: "
SAME_LANGUAGE = "Ngôn ngữ nguồn và đích không được giống nhau."


def invalid_reason(src: Column, tgt: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """First rule a cleaned pair breaks: ``empty``, ``comment`` or ``length``;
    NULL for a valid pair."""
    src, tgt = F.coalesce(src, F.lit("")), F.coalesce(tgt, F.lit(""))
    return (
        F.when((src == "") | (tgt == ""), "empty")
        .when(src.startswith("#") | tgt.startswith("#"), "comment")
        .when(~(F.length(src).between(low, high) & F.length(tgt).between(low, high)), "length")
    )


def is_valid_pair(src: Column, tgt: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """No side is empty, starts with ``#`` or has a length outside
    ``low..high``. One pattern names each side once, so a cleaned side that is
    an expression is computed once."""
    pattern = rf"(?s)\A[^#].{{{low - 1},{high - 1}}}\z"
    return F.coalesce(src.rlike(pattern) & tgt.rlike(pattern), F.lit(False))


def maybe_valid_pair(src: Column, tgt: Column) -> Column:
    """Cheap test on raw text, implied by validity after cleaning: no cleaning
    step fills an empty side or removes a leading ``#``. Lengths say nothing
    here, since composition can lengthen a text. Goes before the cleaning
    when rejected rows need not be counted."""
    return (src != "") & (tgt != "") & ~src.startswith("#") & ~tgt.startswith("#")


def non_empty_pair(src: Column, tgt: Column) -> Column:
    def filled(c):
        return strip_unicode(F.coalesce(c, F.lit(""))) != ""

    return filled(src) & filled(tgt)


def has_tab(line: Column) -> Column:
    """A TAB survives stripping, so the line has two fields."""
    return strip_unicode(line).contains("\t")


def non_blank_line(line: Column) -> Column:
    return line.rlike(f"[^{WS}]")


def validate_request(
    text: Column,
    source_lang: Column,
    target_lang: Column,
    languages: Sequence[str] = LISTED_LANGUAGES,
) -> tuple[Column, Column]:
    """``(status, detail)`` of a request; rules are tried in this order: text,
    source language, target language, equal languages."""
    known = list(languages)
    listed = "[" + ", ".join(f"'{name}'" for name in known) + "]"
    detail = (
        F.when(strip_unicode(F.coalesce(text, F.lit(""))) == "", EMPTY_TEXT)
        .when(~F.coalesce(source_lang.isin(known), F.lit(False)), BAD_SOURCE + listed)
        .when(~F.coalesce(target_lang.isin(known), F.lit(False)), BAD_TARGET + listed)
        .when(source_lang == target_lang, SAME_LANGUAGE)
    )
    status = F.when(detail.isNotNull(), 400).otherwise(200)
    return status, detail


def direct_pairs(languages: Sequence[str], english: str) -> list[tuple[str, str]]:
    """Directly served directions: English on exactly one side."""
    others = [lang for lang in languages if lang != english]
    return [(english, o) for o in others] + [(o, english) for o in others]


def use_pivot(source_lang: Column, target_lang: Column, direct: Sequence[tuple[str, str]]) -> Column:
    """True when the direction is not served directly."""
    hit = F.lit(False)
    for source, target in direct:
        hit = hit | ((source_lang == source) & (target_lang == target))
    return ~hit


def resolve_same_language(changed: Column, other: Column, options: Sequence[str]) -> Column:
    """New value of ``other`` after ``changed`` was picked: if both are equal,
    the first different option in form order."""
    opts = F.array(*[F.lit(o) for o in options])
    first_other = F.element_at(F.filter(opts, lambda o: o != changed), 1)
    return F.when(changed == other, first_other).otherwise(other)


def swapped_text(text: Column, output: Column, output_ok: Column) -> Column:
    """Input text after the two languages were swapped: the earlier output if
    there was one without error, else the old text."""
    usable = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(output, F.lit("")) != "") & output_ok
    return F.when(usable, output).otherwise(text)
