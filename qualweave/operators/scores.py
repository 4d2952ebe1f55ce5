"""Features of positions, and two scorers in plain SQL.

The scorers stand for a model whose logits are known: uniform (all logits 0) and
predictor (logits are ln P0 of each residual). Both go through the mask of legal
residuals and a softmax; their closed forms avoid arrays at every position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.constants import ALPHABET, EPS
from qualweave.functions import predictor, symbols
from qualweave.operators.split import counted
from qualweave.sources.views import Sequences, predictors

#: The masked logit, as in the model.
MASKED = -1e9


def features(view: Sequences, described: DataFrame | None = None, fraction: float | None = None) -> DataFrame:
    """Positions with q_hat, max_prob, entropy, expected_q, p_true, true_freq, residual and target.

    described: predictor.described(...), one row for each distinct vector; broadcast if a count finds few.
    Positions with counts of their own are described in place, without a join.
    An id outside the alphabet, or a class outside its range, is an error where it is read.
    """
    positions = view.positions.withColumn("observed", symbols.checked_id(F.col("observed")))
    if view.own_counts:
        joined = predictor.described(positions).drop("total")
    else:
        if described is None:
            described = predictor.described(predictors(view, fraction) if fraction else predictors(view))
        joined = positions.join(counted(described.drop("total")), ["file", "pred_key"], "left")
    out = joined.withColumns({"p_true": F.get("probs", "observed"), "true_freq": F.get("freqs", "observed"), "residual": symbols.residual(F.col("observed"), F.col("q_hat"))})
    return out.withColumn("target", symbols.checked_class(symbols.target(F.col("residual"))))


def uniform(df: DataFrame) -> DataFrame:
    """Adds model_prob, pred_residual, pred_prob: every legal residual alike; the least is predicted."""
    return df.withColumns({"model_prob": F.lit(1.0 / ALPHABET), "pred_residual": -F.col("q_hat"), "pred_prob": F.lit(1.0 / ALPHABET)})


def by_predictor(df: DataFrame) -> DataFrame:
    """Adds model_prob, pred_residual, pred_prob: floored P0, normalised over the legal ids."""
    floored = predictor.floored
    return df.withColumns({"model_prob": floored(F.col("p_true")) / F.col("floored_sum"), "pred_residual": F.lit(0), "pred_prob": floored(F.col("max_prob")) / F.col("floored_sum")})


def bits(df: DataFrame) -> DataFrame:
    """Adds baseline_bits and model_bits."""
    return df.withColumns({"baseline_bits": -F.log2(F.greatest("p_true", F.lit(EPS))), "model_bits": -F.log2(F.greatest("model_prob", F.lit(1e-300)))})
