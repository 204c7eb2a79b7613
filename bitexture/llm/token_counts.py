"""Token counts of texts under a given tokenizer file."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a tokenizer file that may be sent to the tasks.
MAX_FILE = 64 << 20
#: UTF-8 bytes that go to the tokenizer at once.
BATCH_BYTES = 1 << 20
#: Pieces longer than this are cut again, and their counts aren't remembered.
LONG_PIECE = 128
#: Counts a task remembers; then it starts anew.
_REMEMBERED = 500_000

# \x1c to \x1f are white space in Python, but not for the tokenizers
_SPACE, _SIGN = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# letters that have always been letters, signs that have never been any
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ぀-ゖァ-ヺ一-龥가-힣"
_NO_LETTER = "!-@\\[-`{-~、。〈-】！，．：；？"
_WORD = re.compile(f"{_SPACE}*[{_LETTER}]+(?=[{_NO_LETTER}])|{_SPACE}*{_SIGN}+|{_SPACE}+")
_WHOLE_WORD = re.compile(f"{_SPACE}*{_SIGN}+|{_SPACE}+")
_LETTER_END = re.compile(f"(?<=[{_LETTER}])(?=[{_NO_LETTER}])")

Count = Callable[[list[str]], list[int]]


class Cuts(NamedTuple):
    """Where a tokenizer's texts may be cut."""

    pieces: re.Pattern
    special: re.Pattern | None


def safe_pieces(text: str, cuts: Cuts) -> list[str]:
    """``text`` cut where byte-level tokenizers always begin a new word, so that
    the counts of the pieces add up to that of the text: before white space
    that follows another sign, and after letters before a sign, but never within
    a special string. A piece without such a place stays whole."""
    found = cuts.pieces.findall(text)
    if len(text) <= LONG_PIECE or max(map(len, found)) <= LONG_PIECE:
        return found
    out = []
    for piece in found:
        if len(piece) > LONG_PIECE:
            kept = [m.span() for m in cuts.special.finditer(piece)] if cuts.special else []
            starts, nth, at = [m.start() for m in _LETTER_END.finditer(piece)], 0, 0
            for cut in starts:
                while nth < len(kept) and kept[nth][1] <= cut:
                    nth += 1
                if cut - at >= LONG_PIECE // 2 and not (nth < len(kept) and kept[nth][0] < cut):
                    out.append(piece[at:cut])
                    at = cut
            piece = piece[at:]
        out.append(piece)
    return out


def batches_by_bytes(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of together ``most`` UTF-8 bytes or one text more."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text.encode())
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


@lru_cache(4)
def load_counter(digest: str, kind: str, data: Callable[[], bytes]) -> tuple[Count, Cuts | None]:
    """How to count the tokens of a batch, and where its texts may be cut (None:
    nowhere). Built once in a Python worker."""
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data())
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    said = json.loads(data())
    split = said.get("pre_tokenizer") or {}
    added = said.get("added_tokens") or []
    strings = [t["content"] for t in added]
    if (
        split.get("type") != "ByteLevel"
        or not split.get("use_regex", True)
        or split.get("add_prefix_space", True)
        or said.get("normalizer") is not None
        # tokens that take the white space or look at the letters around them
        or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
    ):
        return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], None

    def count(pieces: list[str]) -> list[int]:
        # pieces in one go, each for itself: the library says of which piece a token is
        encoded = tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(pieces)).tolist()

    letters_first = any(re.match(f"[{_LETTER}]", s) for s in strings)
    special = re.compile("|".join(map(re.escape, strings))) if strings else None
    return count, Cuts(_WHOLE_WORD if letters_first else _WORD, special)


class _Source:
    """Bytes of the file; hashable by digest, so that ``load_counter`` finds them again."""

    def __init__(self, shared, digest: str) -> None:
        self.shared, self.digest = shared, digest

    def __call__(self) -> bytes:
        return self.shared.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Source) and self.digest == other.digest


def count_tokens(texts: list[str], count: Count, cuts: Cuts | None, known: dict[str, int]) -> list[int]:
    """Token counts of ``texts``. ``known`` keeps the counts of short pieces."""
    rows = [safe_pieces(text, cuts) if cuts else [text] if text else [] for text in texts]
    fresh = {piece for pieces in rows for piece in pieces if piece not in known}
    long = {}
    for batch in batches_by_bytes(fresh):
        for piece, n in zip(batch, count(batch)):
            (known if len(piece) <= LONG_PIECE else long)[piece] = n
    get = known.__getitem__
    if long:
        get = lambda piece: known[piece] if piece in known else long[piece]
    totals = [sum(map(get, pieces)) for pieces in rows]
    if len(known) > _REMEMBERED:
        known.clear()
    return totals


def _groups(column: pa.Array, most: int) -> Iterator[list[str]]:
    """The texts of a column in groups of about ``most`` bytes, whatever the
    number of rows."""
    group, size = [], 0
    for value in column:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def with_token_counts(docs: DataFrame, tokenizer: str, limit: int, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens) for the tokenizer file ``tokenizer`` (``.json`` or
    ``.model``), named with ``prefix``.

    Counts are those of the file's library without begin, end or other added
    tokens, truncation or padding; special strings inside a text count as the
    library counts them by default. Whole texts count, however long: for
    byte-level tokenizers texts are cut at places where a new word surely
    begins, and equal pieces are counted once in a batch; other kinds get
    whole texts. Only counts leave the Python workers. NULL and empty texts
    have no bytes and no tokens; repeated rows and NULLs in other columns stay
    as they are. Columns of the result's names are replaced. The file is read
    by the driver and shared with the tasks; it may have 64 MB at most.
    """
    file = Path(tokenizer)
    if file.suffix not in (".json", ".model"):
        raise ValueError(f"no tokenizer of a known kind: {tokenizer}")
    if file.stat().st_size > MAX_FILE:
        raise ValueError(f"tokenizer file of more than {MAX_FILE} bytes: {tokenizer}")
    data, kind = file.read_bytes(), file.suffix
    digest = hashlib.sha256(data).hexdigest()
    source = _Source(docs.sparkSession.sparkContext.broadcast(data), digest)

    @F.arrow_udf("bigint")
    def tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, cuts = load_counter(digest, kind, source)
        known: dict[str, int] = {}
        for column in columns:
            totals: list[int] = []
            for group in _groups(column, 8 * BATCH_BYTES):
                totals += count_tokens(group, count, cuts, known)
            yield pa.array(totals, pa.int64())

    n_bytes, n_tokens, over = (prefix + n for n in ("n_bytes", "n_tokens", "over_limit"))
    kept = [c for c in docs.columns if c not in (n_bytes, n_tokens, over)]
    if text not in kept:
        raise ValueError(f"the text column can't be named {text}")
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(*kept, F.octet_length(whole).cast("bigint").alias(n_bytes), tokens(whole).alias(n_tokens))
    return counted.withColumn(over, F.col(n_tokens) > limit)
