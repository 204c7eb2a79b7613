"""Candidate search over score tables.

``next_scores``: ``prev, next, logprob``, the log probability of each next
token; with a column ``src_id`` every source has scores of its own. ``beams``:
``src_id, log_prob, tokens``.

With one score table for all, the sources move together, one output position
per step. Scores of their own are gathered by source once, and the search runs
on the rows, many sources of a batch at a time: no exchange per position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.functions.arrays import BOS_ID, EOS_ID, MAX_LEN, PAD_ID, drop_special
from bitexture.functions.scores import LENGTH_PENALTY, length_penalized
from bitexture.session import checkpointed

BEAM_SIZE = 5
# Log probabilities are rounded to this many digits after each addition, so
# equal sums are equal in any order of addition.
DIGITS = 6


# A score table of at most so many rows may be sent to all tasks.
MAX_BROADCAST = 500_000


def _states(next_scores: DataFrame) -> list[str]:
    """Columns that a continuation depends on."""
    return ["src_id", "prev"] if "src_id" in next_scores.columns else ["prev"]


def top_next(next_scores: DataFrame, k: int = BEAM_SIZE) -> DataFrame:
    """The ``k`` best next tokens per token (and source, where there is one).
    Spark keeps ``k`` rows per token in each task before the shuffle, so
    frequent tokens stay cheap."""
    states = _states(next_scores)
    w = Window.partitionBy(*states).orderBy(F.desc("logprob"), "next")
    return (
        next_scores.withColumn("__r", F.row_number().over(w))
        .where(F.col("__r") <= k)
        .select(*states, "next", "logprob")
    )


def beam_expand(beams: DataFrame, next_scores: DataFrame, k: int = BEAM_SIZE, eos: int = EOS_ID) -> DataFrame:
    """Every live beam takes its ``k`` best next tokens, from the scores of its
    own source where they have a ``src_id``."""
    return _expand(beams, top_next(next_scores, k), eos)


def _expand(beams, best, eos):
    live = beams.withColumn("prev", F.element_at("tokens", -1)).where(F.col("prev") != eos)
    return live.join(best, _states(best)).select(
        "src_id",
        F.round(F.col("log_prob") + F.col("logprob"), DIGITS).alias("log_prob"),
        F.concat("tokens", F.array("next")).alias("tokens"),
    )


def beam_prune(
    candidates: DataFrame, k: int = BEAM_SIZE, eos: int = EOS_ID, alpha: float = LENGTH_PENALTY
) -> DataFrame:
    """Adds ``score`` and ``state``: ended candidates are all ``finished``, the
    ``k`` best others per source ``live``; the rest goes."""
    score = F.round(length_penalized(F.col("log_prob"), F.size("tokens"), alpha), DIGITS)
    ranked = candidates.withColumn("score", score).withColumn("__end", F.element_at("tokens", -1) == eos)
    w = Window.partitionBy("src_id", "__end").orderBy(F.desc("score"), "tokens")
    return (
        ranked.withColumn("__r", F.row_number().over(w))
        .where(F.col("__end") | (F.col("__r") <= k))
        .withColumn("state", F.when(F.col("__end"), "finished").otherwise("live"))
        .drop("__r", "__end")
    )


def distinct_hypotheses(finished: DataFrame) -> DataFrame:
    return finished.dropDuplicates(["src_id", "tokens"])


def nbest_select(beams: DataFrame) -> DataFrame:
    """Best hypothesis per source by ``score``: finished ones first; where a
    source has none, its best live beam. Markers are dropped from the ids."""
    order = F.struct(
        (F.col("state") == "finished").alias("f"),
        F.col("score").alias("s"),
        # the smallest token list wins a tie
        F.transform("tokens", lambda t: -t).alias("t"),
    )
    best = beams.groupBy("src_id").agg(
        F.max_by(F.struct("score", "state", "tokens"), order).alias("b"), F.count(F.lit(1)).alias("n_hyps")
    )
    return best.select(
        "src_id",
        F.col("b.score").alias("score"),
        F.col("b.state").alias("state"),
        drop_special(F.col("b.tokens"), (PAD_ID, BOS_ID, EOS_ID)).alias("ids"),
    )


def greedy_next(next_scores: DataFrame) -> DataFrame:
    """Most probable next token of each token."""
    order = F.struct("logprob", (-F.col("next")).alias("n"))
    return next_scores.groupBy("prev").agg(
        F.max_by("next", order).alias("next"), F.max("logprob").alias("logprob")
    )


def decode_corpus(
    sources: DataFrame,
    next_scores: DataFrame,
    k: int = BEAM_SIZE,
    max_len: int = MAX_LEN,
    eos: int = EOS_ID,
    alpha: float = LENGTH_PENALTY,
) -> DataFrame:
    """Beam search for a whole table: ``sources`` has ``src_id`` and the first
    ``tokens``; returns the best ids per source. With a column ``src_id`` in
    ``next_scores`` a source is continued by its own scores only.

    A live beam whose last token has no continuation stays as it is, as its
    source's answer if nothing else ends, so every source has one row.

    With one table for all, step ``i`` handles position ``i`` of all sources.
    Live beams are checkpointed each step (their size is at most ``k`` per
    source); finished hypotheses of a step are reduced to the best one per
    source. A table of more than ``MAX_BROADCAST`` rows is joined by shuffle.
    """
    if "src_id" in next_scores.columns:
        return _decode_each(sources, next_scores, k, max_len, eos, alpha)
    best = checkpointed(top_next(next_scores, k))
    if best.count() <= MAX_BROADCAST:
        best = F.broadcast(best)
    live = sources.select(
        "src_id", F.lit(0.0).alias("log_prob"), F.col("tokens").cast("array<int>").alias("tokens")
    )
    done = []
    last = None
    for _ in range(max_len):
        done.append(_stuck(live, best, eos, alpha))
        step = checkpointed(beam_prune(_expand(live, best, eos), k, eos, alpha))
        done.append(_best_finished(step))
        live = step.where(F.col("state") == "live")
        last = live
        if live.isEmpty():
            break
    parts = done + ([last] if last is not None else [])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return nbest_select(out)


def _stuck(live, best, eos, alpha):
    """Beams that no token can follow; those that have ended count as such."""
    ends = live.withColumn("prev", F.element_at("tokens", -1)).join(best, "prev", "left_anti")
    score = F.round(length_penalized(F.col("log_prob"), F.size("tokens"), alpha), DIGITS)
    state = F.when(F.col("prev") == eos, "finished").otherwise("live")
    return ends.select("src_id", "log_prob", "tokens", score.alias("score"), state.alias("state"))


def _best_finished(step):
    order = F.struct("score", F.transform("tokens", lambda t: -t).alias("t"))
    one = step.where(F.col("state") == "finished").groupBy("src_id").agg(
        F.max_by(F.struct("log_prob", "tokens", "score", "state"), order).alias("b")
    )
    return one.select("src_id", "b.log_prob", "b.tokens", "b.score", "b.state")


_ANSWER = T.StructType().add("ended", T.BooleanType()).add("score", T.DoubleType()).add("tokens", T.ArrayType(T.IntegerType()))
#: Sources whose search advances together inside a task.
TOGETHER = 512


def scores_by_source(next_scores: DataFrame, k: int = BEAM_SIZE) -> DataFrame:
    """``src_id, scores``: the ``k`` best next tokens of every token of a source
    as one list. Its size is bounded by the vocabulary, whatever the source."""
    entry = F.struct(F.col("prev").cast("int"), F.col("next").cast("int"), "logprob")
    return top_next(next_scores, k).groupBy("src_id").agg(F.collect_list(entry).alias("scores"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero, as ``round`` of a column; no negative zero."""
    unit = 10.0**DIGITS
    return np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x) + 0.0


class _Answers:
    """The best answer of each source so far: ended ones first, then the higher
    score, then the smaller token list."""

    def __init__(self, n: int, width: int) -> None:
        self.ended, self.score = np.full(n, -1, np.int8), np.full(n, -np.inf)
        self.tokens, self.sizes = np.full((n, width), _PAST, np.int32), np.zeros(n, np.int64)

    def offer(self, at: np.ndarray, ended: np.ndarray, score: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        was, best = self.ended[at], self.score[at]
        better = (ended > was) | ((ended == was) & (score > best))
        tied = np.flatnonzero((ended == was) & (score == best))
        if len(tied):
            old, new = self.tokens[at[tied]], tokens[tied]
            first = (old != new).argmax(axis=1)[:, None]
            better[tied] = np.take_along_axis(new, first, 1)[:, 0] < np.take_along_axis(old, first, 1)[:, 0]
        at, pick = at[better], np.flatnonzero(better)
        self.ended[at], self.score[at], self.tokens[at], self.sizes[at] = ended[pick], score[pick], tokens[pick], sizes[pick]


_PAST = np.iinfo(np.int32).max  # behind the last token


def _search(starts: pa.Array, scores: pa.Array, k: int, max_len: int, eos: int, alpha: float) -> _Answers:
    """Beam search of some sources by their own scores, one position of all of
    them at a time. Beams of a source are equally long, so token lists compare
    as the places of their beams before, then by the new token."""
    n = len(starts)
    sizes = np.asarray(pc.fill_null(starts.value_lengths(), 0)).astype(np.int64)
    width = int(sizes.max(initial=0)) + max_len
    entries, lengths = scores.flatten(), np.asarray(pc.fill_null(scores.value_lengths(), 0))
    prev, following, logprob = (np.asarray(entries.field(i)) for i in range(3))
    key = np.repeat(np.arange(n), lengths) << 32 | prev.astype(np.int64) & 0xFFFFFFFF
    order = np.lexsort((following, -logprob, key))
    following, logprob = following[order], logprob[order]
    known, begins, counts = np.unique(key[order], return_index=True, return_counts=True)
    found = _Answers(n, width)
    rows = np.arange(n)
    tokens = np.full((n, 1, width), _PAST, np.int32)
    tokens[np.repeat(rows, sizes), 0, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = starts.flatten()
    log_prob, alive, place = np.zeros((n, 1)), np.ones((n, 1), bool), np.zeros((n, 1), np.int64)

    def rate(log_prob, size):
        return _rounded(log_prob / np.maximum(size, 1) ** alpha)

    for step in range(max_len):
        size = sizes[rows] + step
        last = np.take_along_axis(tokens, np.maximum(size - 1, 0)[:, None, None], 2)[:, :, 0].astype(np.int64)
        want = rows[:, None] << 32 | last & 0xFFFFFFFF
        spot = np.minimum(np.searchsorted(known, want), len(known) - 1)
        goes = alive & (last != eos) & (known[spot] == want) if len(known) else np.zeros_like(alive)
        for j in np.flatnonzero((alive & ~goes).any(axis=0)):
            i = np.flatnonzero(alive[:, j] & ~goes[:, j])
            found.offer(rows[i], (last[i, j] == eos).astype(np.int8), rate(log_prob[i, j], size[i]), tokens[i, j], size[i])
        on = goes.any(axis=1)
        rows, size, tokens, log_prob, goes, place = rows[on], size[on] + 1, tokens[on], log_prob[on], goes[on], place[on]
        if not len(rows):
            alive = goes
            break
        spot, nth = spot[on], np.arange(k)
        valid = goes[:, :, None] & (nth < counts[spot][:, :, None])
        at = np.where(valid, begins[spot][:, :, None] + nth, 0)
        flat = (len(rows), -1)
        token, valid = following[at].reshape(flat), valid.reshape(flat)
        total = _rounded(log_prob[:, :, None] + logprob[at]).reshape(flat)
        score = rate(total, size[:, None])
        beam = np.repeat(np.arange(place.shape[1]), k)
        # unfinished ones first, each kind best first
        kind = np.where(valid, token == eos, 2)
        sort = np.lexsort((token, place[:, beam], -score, kind), axis=1)
        going = np.take_along_axis(kind, sort[:, :k], 1) == 0
        ends = np.flatnonzero((kind == 1).any(axis=1))
        one = sort[ends, (kind[ends] == 0).sum(axis=1)]
        done = tokens[ends, beam[one]]
        done[np.arange(len(ends)), size[ends] - 1] = eos
        found.offer(rows[ends], np.ones(len(ends), np.int8), score[ends, one], done, size[ends])
        sort = sort[:, :k]
        token = np.take_along_axis(token, sort, 1)
        place = np.take_along_axis(place, beam[sort], 1) << 33 | token.astype(np.int64) + (1 << 31)
        place = np.argsort(np.argsort(place, axis=1), axis=1)
        tokens = np.take_along_axis(tokens, beam[sort][:, :, None], 1)
        np.put_along_axis(tokens, (size - 1)[:, None, None], token[:, :, None], 2)
        log_prob, alive = np.take_along_axis(total, sort, 1), going
    size = np.minimum(sizes[rows] + max_len, width)
    for j in range(alive.shape[1] if len(rows) else 0):
        i = np.flatnonzero(alive[:, j])
        found.offer(rows[i], np.zeros(len(i), np.int8), rate(log_prob[i, j], size[i]), tokens[i, j], size[i])
    return found


def _decode_each(sources, next_scores, k, max_len, eos, alpha) -> DataFrame:
    """The search of ``decode_corpus`` over rows that hold their own scores."""
    scored = sources.select("src_id", F.col("tokens").cast("array<int>").alias("tokens")).join(
        scores_by_source(next_scores, k), "src_id", "left"
    )

    def run(starts: pa.Array, scores: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(starts), TOGETHER):
            part = starts.slice(i, TOGETHER)
            found = _search(part, scores.slice(i, TOGETHER), k, max_len, eos, alpha)
            inside = np.arange(found.tokens.shape[1]) < found.sizes[:, None]
            offsets = np.concatenate([[0], np.cumsum(found.sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.tokens[inside]))
            ended = pa.array(found.ended == 1)
            parts.append(pa.StructArray.from_arrays([ended, pa.array(found.score), lists], _ANSWER.names, mask=pc.is_null(part)))
        return pa.concat_arrays(parts)

    found = scored.select("src_id", F.arrow_udf(run, _ANSWER)("tokens", "scores").alias("b"))
    return found.select(
        "src_id",
        F.col("b.score").alias("score"),
        F.when(F.col("b.ended"), "finished").otherwise("live").alias("state"),
        drop_special(F.col("b.tokens"), (PAD_ID, BOS_ID, EOS_ID)).alias("ids"),
    )
