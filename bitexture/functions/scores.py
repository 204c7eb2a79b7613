"""Score formulas over plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH_PENALTY = 0.7
BLEU_ORDERS = 4


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def noam_lr(step: Column, d_model: int, warmup: int, floor: float = 1e-4) -> Column:
    """Warm-up, then inverse square root decay, never below ``floor``."""
    s = step.cast("double")
    curve = F.least(F.pow(s, F.lit(-0.5)), s * F.lit(float(warmup) ** -1.5))
    return F.greatest(F.lit(float(d_model) ** -0.5) * curve, F.lit(floor))


def length_penalized(log_prob: Column, length: Column, alpha: float = LENGTH_PENALTY) -> Column:
    return log_prob / F.pow(length.cast("double"), F.lit(alpha))


def smoothed_nll(log_prob: Column, mean_log_prob: Column, eps: float = 0.1) -> Column:
    """Label-smoothed negative log likelihood of one token; ``mean_log_prob``
    is the mean over the whole vocabulary."""
    return (1 - eps) * -log_prob + eps * -mean_log_prob


def brevity_penalty(hyp_len: Column, ref_len: Column) -> Column:
    return (
        F.when(hyp_len >= ref_len, F.lit(1.0))
        .when(hyp_len == 0, F.lit(0.0))
        .otherwise(F.exp(1 - ref_len / hyp_len))
    )


def bleu_from_counts(
    matches: list[Column],
    totals: list[Column],
    hyp_len: Column,
    ref_len: Column,
    effective_order: bool = False,
) -> Column:
    """BLEU in percent from clipped n-gram matches and totals per order.

    No match at all gives 0. An order with n-grams but no match uses
    exponential smoothing: ``1 / (2**j * total)`` for the j-th such order. With
    ``effective_order`` the mean runs over the orders that have n-grams (one
    sentence); otherwise a missing order makes the score 0 (a corpus).
    """
    logs, zeros = F.lit(0.0), F.lit(0)
    orders = F.lit(0)
    for m, t in zip(matches, totals):
        empty = t == 0
        zeros = F.when(~empty & (m == 0), zeros + 1).otherwise(zeros)
        p = F.when(m == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * t)).otherwise(m / t)
        logs = logs + F.when(empty, 0.0).otherwise(F.log(p))
        orders = orders + F.when(empty, 0).otherwise(1)
    any_match = matches[0]
    for m in matches[1:]:
        any_match = any_match + m
    score = 100.0 * brevity_penalty(hyp_len, ref_len) * F.exp(logs / orders)
    if not effective_order:
        score = F.when(orders == len(matches), score).otherwise(0.0)
    return F.when(any_match > 0, score).otherwise(0.0)
