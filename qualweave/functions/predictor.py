"""Probabilities and summaries of predictor counts, as array expressions.

They are meant to run once for each distinct vector of counts, not for each position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualweave.constants import ALPHABET, EPS, MAX_ID


def floored(p: Column) -> Column:
    return F.greatest(p, F.lit(EPS))


def total(freqs: Column) -> Column:
    return F.aggregate(freqs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def probabilities(freqs: Column, freqs_total: Column) -> Column:
    """Counts over their sum; all zero for counts that are all zero."""
    return F.transform(freqs, lambda x: x.cast("double") / floored(freqs_total))


def argmax(freqs: Column) -> Column:
    """The lowest id with the largest count; 0 for counts that are all zero."""
    return (F.array_position(freqs, F.array_max(freqs)) - 1).cast("int")


def entropy(probs: Column) -> Column:
    """Over ln 95, so that it lies in [0, 1]."""
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.ln(floored(p))) / math.log(ALPHABET) + F.lit(0.0)


def expectation(probs: Column) -> Column:
    """Over 94, so that it lies in [0, 1]."""
    return F.aggregate(F.transform(probs, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x) / MAX_ID


def residual_log_probs(probs: Column, q_hat: Column) -> Column:
    """ln P0 of q_hat + r for r from -94 to 94; ids outside the alphabet count as probability 0."""
    return F.transform(F.sequence(F.lit(-MAX_ID), F.lit(MAX_ID)), lambda r: F.ln(floored(F.coalesce(F.get(probs, q_hat + r), F.lit(0.0)))))


def described(predictors: DataFrame) -> DataFrame:
    """predictors with total, probs, q_hat, max_prob, entropy, expected_q, and the sum of floored probabilities."""
    df = predictors.withColumn("freqs", F.transform("freqs", lambda x: x.cast("float")))
    df = df.withColumn("total", total(F.col("freqs")))
    df = df.withColumns({"probs": probabilities(F.col("freqs"), F.col("total")), "q_hat": argmax(F.col("freqs"))})
    return df.withColumns(
        {
            "max_prob": F.get("probs", "q_hat"),
            "entropy": entropy(F.col("probs")),
            "expected_q": expectation(F.col("probs")),
            "floored_sum": F.aggregate("probs", F.lit(0.0), lambda a, p: a + floored(p)),
        }
    )
