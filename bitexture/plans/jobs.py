"""Whole jobs: building a training corpus, evaluating a translator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitexture.operators import corpus as C
from bitexture.operators.bleu import best_sentences, bleu_stats, corpus_score, sentence_score, worst_sentences
from bitexture.operators.requests import translate_batch
from bitexture.operators.shuffle import seeded_shuffle
from bitexture.session import stored
from bitexture.sources.text import write_tagged_tsv

MAX_PAIRS = 100_000


def build_corpus(
    sources: Sequence[DataFrame], cap: int = MAX_PAIRS, tags: dict[str, str] | None = None
) -> DataFrame:
    """Training lines ``line_no, lang, direction, src, tgt, value`` of raw
    pair tables (``lang, line_no, src, tgt``): cleaned, validated, capped per
    language, tagged, in both directions. Not yet shuffled."""
    raw = C.union_languages(*[s.select("lang", "line_no", "src", "tgt") for s in sources])
    pairs = C.cap_per_language(raw, cap)
    return C.both_directions(pairs, tags).withColumn("value", C.tagged_line())


def write_corpus(
    sources: Sequence[DataFrame],
    path: str,
    cap: int = MAX_PAIRS,
    seed: str = "42",
    tags: dict[str, str] | None = None,
    newline_policy: str = "space",
) -> DataFrame | None:
    """Builds, shuffles and writes the corpus; returns pairs per language and
    in total. Nothing is written, and None returned, if no pair is valid."""
    lines = stored(build_corpus(sources, cap, tags), "lines")
    if lines.isEmpty():
        return None
    shuffled = seeded_shuffle(lines, ["lang", "line_no", "direction"], seed)
    write_tagged_tsv(shuffled, path, newline_policy)
    return C.pair_summary(lines.where(F.col("direction") == 0))


class Evaluation(NamedTuple):
    hypotheses: DataFrame
    corpus: DataFrame
    sentences: DataFrame
    best: DataFrame
    worst: DataFrame


def evaluate(
    pairs: DataFrame,
    make_translator: Callable[[], Callable[[str], str]],
    tokenizer: str = "13a",
    k: int = 5,
) -> Evaluation:
    """Translates ``src`` of ``id, src, tgt`` and scores it against ``tgt``:
    corpus BLEU, sentence BLEU, and the ``k`` best and worst sentences."""
    # the caller's model runs once, n-grams are counted once, and each sentence
    # is scored once; all of it in one pass
    hyps = translate_batch(pairs, make_translator).select("id", "hyp", F.col("tgt").alias("ref"))
    counted = stored(sentence_score(bleu_stats(hyps, tokenizer)), "scores")
    scored = counted.select(*hyps.columns, "score")
    return Evaluation(scored.select(*hyps.columns), corpus_score(counted), scored, best_sentences(scored, k), worst_sentences(scored, k))
