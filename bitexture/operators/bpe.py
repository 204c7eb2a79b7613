"""Byte-pair vocabulary training and encoding.

Training reads the corpus once, for word counts; after that it works on the
table of distinct words. A word is an array of symbol codes: special tokens have
the lowest codes, then characters by code point, then merged symbols in order.
Codes thus grow with vocabulary ids, and ties between equally frequent pairs
fall as they do in the usual trainer: smaller left id, then smaller right id.

Merges are found one at a time, but many of them in one round over the words:
see ``train_on_words``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.functions.arrays import MAX_LEN, EOS_ID, PAD_ID, add_bos_eos, pad_or_trim
from bitexture.operators.tokens import (
    SPECIAL_TOKENS,
    VOCAB_SIZE,
    decode_text,
    pretokenize,
    vocab_rows,
    word_freq,
)
from bitexture.session import discard, stored

_CODE_POINTS = 0x110000
#: Most frequent pairs that a round considers.
TOP_PAIRS = 4_096
#: Stretches of words, and symbols in them, that the driver may hold in a round.
MAX_STRETCHES = 200_000
MAX_SYMBOLS = 2_000_000
#: Most frequent pairs that the first round of a large corpus considers.
FIRST_PAIRS = 64
#: Symbols of words that a task handles at a time.
SLICE_SYMBOLS = 1 << 19
#: Merges that may be broadcast.
MAX_MERGES = 2_000_000
#: Words whose ids a task keeps for its next batches.
KEPT_WORDS = 200_000
MIN_FREQUENCY = 2


@dataclass
class BpeModel:
    """``vocab(token, id)`` and ``merges(rank, left, right, merged)`` tables.
    Both are bounded by the vocabulary size."""

    vocab: DataFrame
    merges: DataFrame
    specials: tuple[str, ...]


class _Symbols:
    """Codes, texts and ids of all symbols so far, and the merges."""

    def __init__(self, specials: Sequence[str], alphabet: Sequence[int], vocab_size: int) -> None:
        self.ids: dict[str, int] = {t: i for i, t in enumerate(specials)}
        self.text_code, self.code_text = dict(self.ids), {i: t for t, i in self.ids.items()}
        self.vocab_size = vocab_size
        for c in alphabet:
            char = chr(c - len(specials))
            self.ids.setdefault(char, len(self.ids))
            self.code_text[c], self.text_code[char] = char, c
        self.merges: list[tuple[int, str, str, str]] = []
        self._next = _CODE_POINTS + len(specials)

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.vocab_size

    def merge(self, left: int, right: int) -> tuple[int, bool]:
        """Code of the merged symbol, and whether it was there before."""
        text = self.code_text[left] + self.code_text[right]
        known = text in self.text_code
        if not known:
            self.text_code[text], self._next = self._next, self._next + 1
        code = self.text_code[text]
        self.code_text[code] = text
        self.ids.setdefault(text, len(self.ids))
        self.merges.append((len(self.merges), self.code_text[left], self.code_text[right], text))
        return code, known


def _replaced(codes: list[int], left: int, right: int, target: int) -> list[int]:
    out, i, n = [], 0, len(codes)
    while i < n:
        if codes[i] == left and i + 1 < n and codes[i + 1] == right:
            out.append(target)
            i += 2
        else:
            out.append(codes[i])
            i += 1
    return out


def certain_merges(
    stretches: Sequence[tuple[list[int], int]], beyond: tuple[int, int, int] | None, min_frequency: int, symbols: _Symbols
) -> list[tuple[int, int, int]]:
    """The next merges ``left, right, target``, as far as they are certain.

    ``stretches`` are the longest pieces of words in which every adjacent pair
    is one of the most frequent pairs of the corpus, with their frequency, and
    ``beyond`` (``-n, left, right``) is the first pair that is not. A pair that
    comes before it can only be made of symbols whose first ends were such
    pairs as well: merging replaces pairs by pairs that are no more frequent.
    So its count is the one within the stretches, and the merges are those of
    training one at a time until the best pair comes after ``beyond``. A merge
    whose text is a symbol already may make other pairs more frequent; it is the
    last of its round.

    An index from pairs to stretches keeps the work to those that change.
    """
    words = [codes for codes, _ in stretches]
    weights = [n for _, n in stretches]
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for i, codes in enumerate(words):
        for pair in zip(codes, codes[1:]):
            counts[pair] = counts.get(pair, 0) + weights[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and not symbols.full:
        top = heapq.heappop(heap)
        pair = top[1:]
        if counts.get(pair) != -top[0]:
            continue  # counted anew meanwhile
        if -top[0] < max(min_frequency, 1) or (beyond is not None and top > beyond):
            break
        target, known = symbols.merge(*pair)
        merges.append((*pair, target))
        if known:
            break
        changed: dict[tuple[int, int], int] = {}
        for i in where.pop(pair):
            before, n = words[i], weights[i]
            after = _replaced(before, *pair, target)
            if len(after) == len(before):
                continue  # was merged into others since
            words[i] = after
            for p in zip(before, before[1:]):
                changed[p] = changed.get(p, 0) - n
            for p in zip(after, after[1:]):
                changed[p] = changed.get(p, 0) + n
                where.setdefault(p, set()).add(i)
        for p, delta in changed.items():
            if delta:
                counts[p] = counts.get(p, 0) + delta
                if counts[p] > 0:
                    heapq.heappush(heap, (-counts[p], *p))
    return merges


def _pair_keys(batch: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes of a batch, where its words begin and end, and for every code
    but the last one number for it and the next (-1 across words)."""
    sizes = batch.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, ends, _keys(flat, ends)


def _keys(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    keys = flat[:-1] << 32 | flat[1:]
    inner = ends[1:-1]
    keys[inner[(inner > 0) & (inner < len(flat))] - 1] = -1
    return keys


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListArray, np.ndarray]]:
    """Words and their counts, at most ``SLICE_SYMBOLS`` symbols at a time beside
    the longest word, so that memory doesn't grow with the words of a batch."""
    for batch in batches:
        codes, n = batch.column("codes"), batch.column("n").to_numpy(zero_copy_only=False)
        share = (np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // SLICE_SYMBOLS
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(n)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield codes.slice(i, j - i), n[i:j]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _pair_counts(words: DataFrame) -> DataFrame:
    """``left, right, n`` as ``symbol_pair_counts``, with the pairs of many words
    counted at a time before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def total():
            keys, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for codes, n in _slices(batches):
            _, ends, keys = _pair_keys(codes)
            weights = np.repeat(n, np.diff(ends))[:-1]
            held.append(_summed(keys[keys >= 0], weights[keys >= 0]))
            size += len(held[-1][0])
            if size > SLICE_SYMBOLS:
                yield total()
                held, size = [], 0
        if held:
            yield total()

    counted = words.select("codes", "n").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    right = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    return counted.select(F.shiftright("key", 32).cast("int").alias("left"), right.cast("int").alias("right"), "n")


def _alphabet(words: DataFrame) -> list[int]:
    """All codes: bounded by the number of code points."""

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.array([], np.int32)
        for codes, _ in _slices(batches):
            seen = np.union1d(seen, codes.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["c"])

    return sorted(r.c for r in words.select("codes", "n").mapInArrow(codes_of, "c int").distinct().collect())


def _stretches(words: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``codes, n``: the distinct longest pieces of words that have adjacent
    pairs of ``pairs`` only, two symbols or more, with their frequency."""
    wanted = np.sort(np.array([left << 32 | right for left, right in pairs], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _slices(batches):
            flat, ends, keys = _pair_keys(codes)
            inside = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            # a piece begins at a code whose pair with the one before isn't wanted
            linked = np.concatenate([[False], inside])[: len(flat)]
            starts = np.flatnonzero(~linked)
            long = np.flatnonzero(np.diff(np.append(starts, len(flat))) > 1)
            if len(long):
                pieces = _lists(flat, np.append(starts, len(flat))).take(pa.array(long))
                weights = n[np.searchsorted(ends, starts[long], side="right") - 1]
                yield pa.RecordBatch.from_arrays([pieces, pa.array(weights)], names=["codes", "n"])

    return words.select("codes", "n").mapInArrow(cut, "codes array<int>, n bigint").groupBy("codes").agg(F.sum("n").alias("n"))


def _merged(words: DataFrame, merges: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The words after ``merges`` in this order; words of one symbol go."""
    pairs = np.array([left << 32 | right for left, right, _ in merges], np.int64)
    order = np.argsort(pairs)
    wanted, targets = pairs[order], np.array([target for _, _, target in merges], np.int64)
    none = len(merges)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All words take their first merge that is left, then those with more
        to come their next one."""
        for codes, n in _slices(batches):
            flat, ends, keys = _pair_keys(codes)
            last = np.full(len(n), -1)
            while len(n):
                at = np.minimum(np.searchsorted(wanted, keys), none - 1)
                ranks = np.append(np.where(wanted[at] == keys, order[at], none), none)
                sizes = np.diff(ends)
                ranks[ranks <= np.repeat(last, sizes)] = none
                first = np.minimum.reduceat(ranks, ends[:-1])
                more = first < none
                stays = np.repeat(~more, sizes)
                left = ~more & (sizes > 1)
                if left.any():
                    kept = np.repeat(left, sizes)
                    done = _lists(flat[kept], np.concatenate([[0], np.cumsum(sizes[left])]))
                    yield pa.RecordBatch.from_arrays([pa.array(n[left]), done], names=["n", "codes"])
                flat, ranks, n, last, sizes = flat[~stays], ranks[~stays], n[more], first[more], sizes[more]
                hits = ranks == np.repeat(last, sizes)
                # of places that overlap (one symbol repeated) every second one
                places = np.flatnonzero(hits)
                runs = np.flatnonzero(np.diff(places, prepend=-2) > 1)
                offset = np.arange(len(places)) - np.repeat(runs, np.diff(np.append(runs, len(places))))
                places = places[offset % 2 == 0]
                word = np.repeat(np.arange(len(n)), sizes)
                flat[places] = targets[ranks[places]]
                keep = np.ones(len(flat), bool)
                keep[places + 1] = False
                flat = flat[keep]
                ends = np.concatenate([[0], np.cumsum(np.bincount(word[keep], minlength=len(n)))])
                keys = _keys(flat, ends)

    return words.select("codes", "n").mapInArrow(apply, "n bigint, codes array<int>")


def train_bpe(
    texts: DataFrame,
    column: str = "text",
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    specials: Sequence[str] = SPECIAL_TOKENS,
) -> BpeModel:
    """Learns merges: each time the most frequent adjacent pair becomes one
    symbol, until the vocabulary is full or no pair reaches
    ``min_frequency``. Special tokens come first, then characters in code point
    order, then merged symbols.

    See ``train_on_words``, which learns them from the counted words.
    """
    return train_on_words(word_freq(texts, column), vocab_size, min_frequency, specials)


def train_on_words(
    freq: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    specials: Sequence[str] = SPECIAL_TOKENS,
) -> BpeModel:
    """``train_bpe`` from distinct words and their counts, ``token, n``.

    A round counts the pairs of all words and takes the most frequent ones, up
    to ``TOP_PAIRS``. The pieces of words that are made of such pairs, counted by
    distinct piece, are all it takes to know the next merges exactly, down to
    the first pair that is not among them (``certain_merges``), often thousands.
    They are then applied to the words where they are. The driver sees the top
    pairs, the vocabulary, and at most ``MAX_STRETCHES`` pieces with
    ``MAX_SYMBOLS`` symbols: while there are more, the round takes fewer pairs,
    down to one, whose pieces are not needed. Where the words themselves are
    more than that, the first round takes ``FIRST_PAIRS`` and each other four
    times as many as the one before. Words are written once a round.
    """
    spark = freq.sparkSession
    shift = len(specials)  # codes below are those of the special tokens
    codes = F.transform(F.split("token", ""), lambda ch: F.ascii(ch) + shift)
    # the loop computes on few rows with much work each: keep all cores busy
    words = freq.select(F.col("n").cast("bigint").alias("n"), codes.alias("codes"))
    words = stored(words.repartition(spark.sparkContext.defaultParallelism), "words")
    symbols = _Symbols(specials, _alphabet(words), vocab_size)
    most = FIRST_PAIRS
    while not symbols.full:
        # the last one only says where certainty ends
        top = (
            _pair_counts(words)
            .where(F.col("n") >= max(min_frequency, 1))
            .orderBy(F.desc("n"), "left", "right")
            .limit(TOP_PAIRS + 1)
            .collect()
        )
        if not top:
            break
        if most < TOP_PAIRS and words.count() <= MAX_STRETCHES:
            most = TOP_PAIRS
        take = min(most, TOP_PAIRS, len(top))
        while True:
            beyond = (-top[take].n, top[take].left, top[take].right) if take < len(top) else None
            pairs = [(r.left, r.right) for r in top[:take]]
            if take == 1:
                pieces = [(list(pairs[0]), top[0].n)]
                break
            found = stored(_stretches(words, pairs), "stretches")
            rows, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
            small = rows <= MAX_STRETCHES and size <= MAX_SYMBOLS
            pieces = list(zip(*(c.to_pylist() for c in found.select("codes", "n").toArrow().columns))) if small else []
            discard(found)
            if small:
                break
            take = max(1, take // 4)
        most = 4 * take
        merges = certain_merges(pieces, beyond, min_frequency, symbols)
        if symbols.full:
            break
        after = stored(_merged(words, merges), "words")
        discard(words)
        words = after
    discard(words)
    vocab = spark.createDataFrame(sorted(symbols.ids.items(), key=lambda kv: kv[1]), "token string, id int")
    table = spark.createDataFrame(symbols.merges, "rank int, left string, right string, merged string")
    return BpeModel(vocab, table, tuple(specials))


def bpe_ids(words: Column, model: BpeModel, unk: str = "[UNK]") -> Column:
    """Array of words to array of ids, as a Column.

    Runs on the rows where they are: the model is broadcast, each distinct
    word of an Arrow batch is encoded once, and its ids are kept for the task's
    next batches. No shuffle, whatever words repeat.
    """
    ids = dict(zip(*vocab_rows(model.vocab)))
    ranks = {(r.left, r.right): r["rank"] for r in model.merges.limit(MAX_MERGES + 1).collect()}
    if len(ranks) > MAX_MERGES:
        raise ValueError("too many merges to broadcast")
    specials = frozenset(model.specials)
    shared = model.vocab.sparkSession.sparkContext.broadcast((ids, ranks, ids[unk], specials))
    kept: dict[str, list[int]] = {}

    def encode(batch: pa.Array) -> pa.Array:
        import pyarrow as arrow
        import pyarrow.compute as pc

        ids, ranks, unk_id, specials = shared.value

        def word_ids(word):
            if word in specials:
                return [ids[word]]
            # linked symbols, and a heap of the pairs by rank and place; a pair
            # whose symbols have changed meanwhile is stale
            parts, n = list(word), len(word)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            heapq.heapify(heap)
            while heap:
                _, i, left, right = heapq.heappop(heap)
                j = after[i]
                if parts[i] != left or j >= n or parts[j] != right:
                    continue
                parts[i], parts[j], after[i] = left + right, None, after[j]
                if after[i] < n:
                    before[after[i]] = i
                for a in (before[i], i):
                    b = after[a] if a >= 0 else n
                    if b < n and (rank := ranks.get((parts[a], parts[b]))) is not None:
                        heapq.heappush(heap, (rank, a, parts[a], parts[b]))
            return [ids.get(p, unk_id) for p in parts if p is not None]

        def kept_ids(word):
            found = kept.get(word)
            if found is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                found = kept[word] = word_ids(word)
            return found

        coded = pc.dictionary_encode(batch.flatten())
        distinct = arrow.array([kept_ids(w) for w in coded.dictionary.to_pylist()], arrow.list_(arrow.int32()))
        per_word = distinct.take(coded.indices)
        # ids before each word, then before each row
        word_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(per_word).to_numpy(zero_copy_only=False))])
        words_before = np.concatenate([[0], np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        offsets = word_ends[words_before.astype("int64")].astype("int32")
        return arrow.ListArray.from_arrays(arrow.array(offsets), per_word.flatten())

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))(words)


def bpe_encode(
    df: DataFrame, model: BpeModel, column: str = "text", name: str = "ids", markers: bool = True
) -> DataFrame:
    """Adds the ids of a text column, with begin and end markers."""
    ids = bpe_ids(pretokenize(F.col(column), model.specials), model)
    return df.withColumn(name, add_bos_eos(ids) if markers else ids)


def bpe_decode(
    df: DataFrame, model: BpeModel, column: str = "ids", name: str = "text", skip_special: bool = True
) -> DataFrame:
    """Ids back to tokens joined by blanks; special tokens come first in the
    vocabulary, so their ids are known."""
    return decode_text(df, model.vocab, column, name, range(len(model.specials)) if skip_special else ())


def encode_dataset(
    pairs: DataFrame, model: BpeModel, length: int = MAX_LEN, pad: int = PAD_ID, eos: int = EOS_ID
) -> DataFrame:
    """Pairs to fixed-length id arrays ``src_ids, tgt_ids``; both sides go to
    Python in one pass."""
    out = bpe_encode(bpe_encode(pairs, model, "src", "src_ids"), model, "tgt", "tgt_ids")
    return out.withColumns(
        {c: pad_or_trim(F.col(c), length, pad, eos) for c in ("src_ids", "tgt_ids")}
    )


class Tokenizer:
    """A trained model with its ids at hand."""

    def __init__(self, model: BpeModel):
        self.model = model
        index = {t: i for i, t in enumerate(model.specials)}
        self.pad_id = index.get("[PAD]", 0)
        self.bos_id = index["[BOS]"]
        self.eos_id = index["[EOS]"]

    @property
    def vocab_size(self) -> int:
        return self.model.vocab.count()

    def encode(self, df: DataFrame, column: str = "text", name: str = "ids") -> DataFrame:
        return bpe_encode(df, self.model, column, name)

    def decode(
        self, df: DataFrame, column: str = "ids", name: str = "text", skip_special: bool = True
    ) -> DataFrame:
        return bpe_decode(df, self.model, column, name, skip_special)
