"""Toxicity of texts after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 3_000
#: Documents of the sample that a feature must be in.
MIN_DOCS = 3
EPOCHS = 12
PREFIXES = (4, 5, 6, 7)

# fixed values: the alphabet of the language model; 0 is whatever stands
# between words, the last is any other letter
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
OTHER = len(LETTERS) + 1
SYMBOLS = OTHER + 1

# fixed values: letters that a sign is often written for
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "o", "&": "e", "?": "",
}
#: Signs that are only put between letters.
SEPARATORS = frozenset(".-_*~·'`,;:/\\^")
#: Costs of the channel, in nats.
COST_SIGN, COST_STAR, COST_DROP, COST_COLLAPSE, COST_KEEP_LONG = 1.0, 2.0, 6.0, 0.7, 2.5

_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_WORDS = re.compile(r"[^\W\d_]+")
_INNER_SIGN = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+(€£¡*#%&][\d@$!|+(€£¡*#%&]{0,2}[^\W\d_]|^[\d@$!|(€£¡]{1,2}[^\W\d_]{2}|[^\W\d_]{2}[\d@$]\W*$")
_SEPARATED = re.compile(r"^[^\w\s]*(?:[\w@$!|€£¡][.\-_*~·'`,;:/\\^]{1,2}){3,}[\w@$!|€£¡][^\w\s]*$")
_EDGE = "".join(sorted(SEPARATORS)) + "\"()[]{}<>?!#%&$="
_CACHE = 400_000


def _codes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x3000):
        if chr(c).isalpha():
            table[c] = OTHER
    table[0x3000:] = OTHER  # scripts without case; signs among them are rare
    for i, ch in enumerate(LETTERS):
        table[ord(ch)] = i + 1
    return table


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three symbols follow one another, over all texts; at most
    ``SYMBOLS ** 3`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _codes(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                s = codes[np.frombuffer(f"  {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["three", "n"])

    summed = docs.select(text).mapInArrow(count, "three int, n bigint").groupBy("three").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    out = np.zeros(SYMBOLS**3)
    out[got["three"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a symbol after two others: counts of three,
    two and one symbols, interpolated."""
    one = counts.sum((0, 1)) + 1.0
    p = one / one.sum()
    two = counts.sum(0)
    p = (two + 20.0 * p) / (two.sum(1, keepdims=True) + 20.0)
    return -np.log((counts + 20.0 * p[None]) / (counts.sum(2, keepdims=True) + 20.0)).astype(np.float32)


def _symbol(c: str) -> int:
    at = LETTERS.find(c)
    return at + 1 if at >= 0 else OTHER


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per run of one character, what may have been meant, and the cost."""
    out = []
    for m in re.finditer(r"(.)\1*", word):
        c, n = m[1], len(m[0])
        if c.isalpha():
            if n == 1:
                out.append([(c, 0.0)])
            elif n == 2:
                out.append([(c * 2, 0.0), (c, COST_KEEP_LONG)])
            else:
                out.append([(c, COST_COLLAPSE), (c * 2, COST_COLLAPSE), (c * n, COST_KEEP_LONG * n)])
            continue
        options = [("", 0.0 if c in SEPARATORS else COST_DROP)]
        for letter in STANDS_FOR.get(c, ""):
            cost = COST_STAR if c in "*#%&?" else COST_SIGN
            options.append((letter, cost))
            if n > 1:
                options.append((letter * 2, cost + COST_COLLAPSE))
        out.append(options)
    return out


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest plain word: Viterbi over the lattice, where a state is the
    last two letters."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(word):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, done) in best.items():
            for letters, price in options:
                x, y, total = a, b, cost + price
                for ch in letters:
                    s = _symbol(ch)
                    total += float(model[x, y, s])
                    x, y = y, s
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, done + letters)
        best = step
    return min((cost + float(model[a, b, 0]), word) for (a, b), (cost, word) in best.items())[1]


def plain_words(token: str, model: np.ndarray) -> tuple[str, ...]:
    """Words of a token in lower case; where it looks disguised, its decoded
    form as well."""
    words = _WORDS.findall(token)
    if _SEPARATED.match(token):
        core = "".join(c for c in token if c not in SEPARATORS)
    elif _INNER_SIGN.search(token) or _LONG_RUN.search(token):
        core = token.strip(_EDGE) if token[:1] not in "$@!|(" else token.rstrip(_EDGE)
    else:
        return tuple(words)
    return (*words, decode(core, model))


def spaced_words(tokens: list[str]) -> Iterator[str]:
    """Runs of four or more single characters, as one token each, and again
    without the first, which may be a word of its own."""
    run: list[str] = []
    for t in [*tokens, ""]:
        if len(t) == 1 and (t.isalnum() or t in "@$!|€£+("):
            run.append(t)
            continue
        if len(run) >= 4:
            yield "".join(run)
            yield "".join(run[1:])
        run = []


def word_features(word: str) -> Iterator[str]:
    yield f"w{word}"
    for k in PREFIXES:
        if len(word) > k:
            yield f"p{word[:k]}"


class Model(NamedTuple):
    letters: np.ndarray
    weights: dict[str, float]
    bias: float


class Reader:
    """Features of texts under a language model; answers for tokens are kept."""

    def __init__(self, letters: np.ndarray, known: dict[str, int] | None = None) -> None:
        self.letters, self.known, self.cache = letters, known, {}

    def _of(self, token: str, core: bool = False) -> tuple:
        words = {*plain_words(token, self.letters)}
        if core:
            words.add(decode(token, self.letters))
        found = dict.fromkeys(f for w in words for f in word_features(w))
        return tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)

    def __call__(self, text: str | None) -> set:
        tokens = (text or "").lower().split()
        out: set = set()
        if len(self.cache) > _CACHE:
            self.cache = {}
        for t in set(tokens):
            got = self.cache.get(t)
            if got is None:
                got = self.cache[t] = self._of(t)
            out.update(got)
        if sum(1 for t in tokens if len(t) == 1) >= 4:
            for t in spaced_words(tokens):
                out.update(self._of(t, core=True))
        return out


def fit(texts: list[str], labels: list[int], letters: np.ndarray, rate: float) -> tuple[dict[str, float], float]:
    """Logistic regression on the features that toxic texts have more often.
    ``rate`` is the share of toxic texts among all labelled ones; the sample may
    hold another."""
    read = Reader(letters)
    sets = [read(t) for t in texts]
    toxic, clean = Counter(), Counter()
    for y, s in zip(labels, sets):
        (toxic if y else clean).update(s)
    n1 = sum(labels)
    n0 = len(labels) - n1
    if not n1 or not n0:
        return {}, math.log((rate + 1e-3) / (1 - rate + 1e-3))
    lift = {f: math.log((n + 0.1) / (n1 + 0.2)) - math.log((clean[f] + 0.5) / (n0 + 1)) for f, n in toxic.items() if n >= MIN_DOCS}
    names = sorted(f for f, v in lift.items() if v > 0.5)
    index = {f: i for i, f in enumerate(names)}
    rows = [np.array(sorted(index[f] for f in s if f in index), np.int64) for s in sets]
    w, g, b, gb = np.zeros(len(names)), np.full(len(names), 1e-6), -2.0, 1e-6
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + w[x].sum())))) - labels[i]
            step = e + 1e-4 * w[x]
            g[x] += step * step
            w[x] -= 0.1 * step / np.sqrt(g[x])
            gb += e * e
            b -= 0.1 * e / math.sqrt(gb)
    shift = math.log((rate + 1e-6) / (1 - rate + 1e-6)) - math.log(n1 / n0)
    return {f: float(v) for f, v in zip(names, w) if v}, b + shift


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: Column | None = None,
    sample: int = SAMPLE_PER_CLASS,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Language model of all texts, and a classifier of at most ``sample``
    labelled documents of each class (those with the smallest hash of the key).
    ``rows`` says which labelled rows may be used."""
    letters = language_model(letter_counts(docs, text))
    given = labels.select(F.col(key).alias("__id"), F.col(label).alias("__y")).where("__y IN (0, 1) AND __id IS NOT NULL")
    given = given.dropDuplicates(["__id"])
    if rows is not None:
        given = given.withColumnRenamed("__id", key).where(rows).withColumnRenamed(key, "__id")
    rate = given.agg(F.avg("__y")).first()[0] or 0.0
    order = F.xxhash64(F.lit("toxic"), F.col("__id").cast("string"))
    picked = None
    for y in (0, 1):
        some = given.where(F.col("__y") == y).orderBy(order, "__id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__id")
        weights, bias = fit(frame["__text"].tolist(), frame["__y"].tolist(), letters, rate)
        return pd.DataFrame({"feature": ["", *weights], "weight": [bias, *weights.values()]})

    # at most two samples in one task
    texts = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    chosen = texts.join(F.broadcast(picked), "__id").dropDuplicates(["__id"]).withColumn("__one", F.lit(1))
    learned = {f: w for f, w in chosen.groupBy("__one").applyInPandas(learn, "feature string, weight double").collect()}
    bias = learned.pop("", math.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return Model(letters, learned, bias)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) to every row.

    Signs for letters, repeated letters and spaced-out words are decoded to the
    likeliest plain words under the character language model; the score is that
    of the plain words. NULL and empty texts get the score of a text without
    features. An input column ``toxicity`` is replaced; equal texts have
    equal scores; without labels of both classes every score is the same.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.letters, list(model.weights), np.array([*model.weights.values(), 0.0]), model.bias))
    readers: dict[int, Reader] = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        letters, names, weights, bias = sent.value
        if not readers:  # one for each worker's share of the rows
            readers[0] = Reader(letters, {f: i for i, f in enumerate(names)})
        read = readers[0]
        sums = [bias + weights[sorted(read(t))].sum() for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums), -30, 30))))

    return docs.drop("toxicity").withColumn("toxicity", score(F.col(text)))
