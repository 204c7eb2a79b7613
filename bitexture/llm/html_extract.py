"""Main text of HTML pages by the best-scoring run of tokens."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements of the HTML standard, by what they mean here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select".split())
ASIDE = frozenset("nav footer aside form button dialog menu fieldset label head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
INLINE_WORD = frozenset("a b i em strong span small code abbr cite q sub sup u s mark font time".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form alertdialog".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead topbar footer comment comments discussion replies reply respond disqus "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget toolbar pagination pager form search copyright disclaimer alert hidden "
    "tags byline".split()
)

#: Score of a tag or word whose kind the labelled pages don't show.
UNSEEN_TAG, UNSEEN_WORD = -0.25, 0.1
#: Pseudo-counts on either side of a weight.
SMOOTHING = 2.0

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_aside(name: str, attributes: str, inside: bool) -> bool:
    """Menus, adverts, forms and the like, by element, role, class or id. A
    ``header`` within the content holds its title."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if not attributes.strip() or name in CONTENT or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id") and HINTS & set(_SPLIT.split(value)) and not (inside and "header" in value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """``kind, text, words, inside, breaks`` of the tags and text runs that are
    not in menus, scripts and the like: the kind of a tag is its name, that of
    a text run the element it stands in. ``inside``: within ``article`` or ``main``;
    ``breaks``: a block begins or ends here."""
    stack: list[tuple[str, bool]] = []  # open elements; do they hide their text?
    at, hidden, content = 0, 0, 0
    lowered = None
    while at <= len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not hidden:
            text = html.unescape(page[at:end])
            n = len(text.split())
            if n or text:
                around = next((s for s, _ in reversed(stack) if s not in INLINE_WORD or s == "a"), "none")
                yield f"word:{around}", text, n, bool(content), False
        if not m:
            return
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if any(s == name for s, _ in stack):
                while stack:
                    s, h = stack.pop()
                    hidden -= h
                    content -= s in CONTENT
                    if s == name:
                        break
        else:
            if name in RAW and not m[3].rstrip().endswith("/"):
                if lowered is None:
                    # only A-Z change, so places stay the same
                    lowered = page.translate({c: c + 32 for c in range(65, 91)})
                close = lowered.find(f"</{name}", at)
                at = len(page) if close < 0 else page.find(">", close) + 1 or len(page)
                continue
            if name in CONTENT and hidden:
                # a menu that was never closed
                stack, hidden = [(s, False) for s, _ in stack], 0
            if name in BLOCK and stack and any(s == "p" for s, _ in stack):
                while True:  # a block ends an open paragraph
                    s, h = stack.pop()
                    hidden -= h
                    content -= s in CONTENT
                    if s == "p":
                        break
            if name not in VOID and not m[3].rstrip().endswith("/"):
                aside = _is_aside(name, m[3], content > 0)
                stack.append((name, aside))
                hidden += aside
                content += name in CONTENT
        if not hidden:
            kind = name if name in BLOCK or name in VOID or name in INLINE_WORD else "other"
            yield f"tag:{kind}", " " if name in ("br", "img", "wbr") else "", 0, bool(content), name in BLOCK


def labelled_counts(page: str) -> Counter:
    """Words and tags of each kind, inside and outside of the content. Pages
    without ``article`` or ``main`` carry no label and count nothing."""
    counts: Counter = Counter()
    any_inside = False
    for kind, _, n, inside, _ in tokens(page):
        counts[kind, inside] += n if kind.startswith("word:") else 1
        any_inside |= inside
    return counts if any_inside else Counter()


def learn_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Score of each kind of token: the share that is inside the content on
    labelled pages, less one half. Every labelled page counts; as many rows
    come to the driver as there are kinds (element names)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(labelled_counts(page or ""))
        names = pa.array([k for k, _ in total], pa.string())
        inside = pa.array([i for _, i in total], pa.bool_())
        yield pa.RecordBatch.from_arrays([names, inside, pa.array(total.values(), pa.int64())], names=["kind", "inside", "n"])

    marked = pages.where(F.col(column).rlike(r"(?i)<(?:article|main)[\s>]")).select(column)
    summed = marked.mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n")
    )
    return {r.kind: (r.a + SMOOTHING / 2) / (r.n + SMOOTHING) - 0.5 for r in summed.collect() if r.n}


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best-scoring run of tokens, joined by an empty line."""
    items, best, start, run, region = [], 0.0, 0, 0.0, (0, 0)
    for i, (kind, text, n, _, breaks) in enumerate(tokens(page or "")):
        items.append((text, breaks))
        word = kind.startswith("word:")
        score = weights.get(kind, UNSEEN_WORD if word else UNSEEN_TAG) * (n if word else 1)
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, region = run, (start, i + 1)
    blocks, block = [], []
    for text, breaks in [*items[slice(*region)], ("", True)]:
        if breaks:
            if joined := " ".join("".join(block).split()):
                blocks.append(joined)
            block = []
        block.append(text)
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None, column: str = "html") -> DataFrame:
    """Adds ``main_text`` to every row.

    A page is a row of tags and words. Each gets the score of its kind, learned
    from the pages that mark their content (``article``, ``main``), and one
    linear scan finds the contiguous run with the largest sum. Menus, headers,
    footers, sidebars, adverts, forms, notices, comments, scripts and styles,
    known by element, role, class or id, are left out wherever they stand.
    NULL and empty pages, and pages without a positive run, have an empty text.
    An input column ``main_text`` is replaced.
    """
    weights = learn_weights(pages, column) if weights is None else weights

    @F.pandas_udf("string")
    def extract(batch: pd.Series) -> pd.Series:
        return batch.map(lambda page: main_text(page, weights))

    return pages.drop("main_text").withColumn("main_text", extract(F.col(column)))
