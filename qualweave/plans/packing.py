"""Reads packed for the network: one row a read, arrays in order of position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.constants import CONTINUOUS
from qualweave.functions import predictor, symbols
from qualweave.operators import history, scores
from qualweave.operators.split import within
from qualweave.plans.network import Config, Read
from qualweave.sources.views import Sequences

#: Continuous features beside the residual log-probabilities, in the order of the input.
SCALARS = ("max_prob", "entropy", "expected_q", "rel_pos", "len_norm")


def packed(view: Sequences, described: DataFrame | None, config: Config, ranges: DataFrame | None = None) -> DataFrame:
    """file, read_id, seq. Reads outside ranges leave before any feature is made; rows that don't match a read's length are an error.

    described: the vectors of the view; None where positions hold their own counts.
    """
    reads, positions = (within(x, ranges) if ranges is not None else x for x in (view.reads, view.positions))
    log_p0 = F.transform(predictor.residual_log_probs(F.col("probs"), F.col("q_hat")), lambda x: x.cast("float"))
    if view.own_counts:
        df = scores.features(Sequences(reads, positions)).withColumn("log_p0_r", log_p0)
    else:
        df = scores.features(Sequences(reads, positions), described.withColumn("log_p0_r", log_p0))
    df = df.drop("probs", "freqs")
    df = history.tokens(history.tokens(history.previous(df), "q", config.q_ks, config.stride, config.q_vocab), "r", config.r_ks, config.stride, config.r_vocab)
    tokens = ["q_hat", "prev_q", "prev_r", *[f"qmer_{i}" for i in range(len(config.q_ks))], *[f"rmer_{i}" for i in range(len(config.r_ks))]]
    # A read without positions, or positions without a read, come out of the full join with nulls.
    df = df.join(reads.where("length <> 0").select("file", "read_id", "length").hint("merge"), ["file", "read_id"], "full").withColumns({"rel_pos": symbols.relative_position(F.col("pos"), F.col("length")), "len_norm": symbols.length_norm(F.col("length"))})
    row = F.struct(
        "pos",
        "observed",
        "target",
        "p_true",
        "true_freq",
        F.array(*[F.col(t).cast("int") for t in tokens]).alias("tokens"),
        F.concat("log_p0_r", F.array(*[F.col(c).cast("float") for c in SCALARS])).alias("continuous"),
    )
    # Places sorted and without a gap up to the length: as many as it says, and the last is one less.
    whole = df.groupBy("file", "read_id").agg(F.sort_array(F.collect_list(row)).alias("seq"), F.max("length").alias("length"))
    dense = F.coalesce((F.size("seq") == F.col("length")) & (F.element_at(F.col("seq"), -1)["pos"] == F.col("length") - 1), F.lit(False))
    message = F.concat_ws(" ", F.lit("row_alignment: read"), "read_id", F.lit("of"), "file")
    return whole.select("file", "read_id", F.when(dense, F.col("seq")).otherwise(F.raise_error(message).cast(whole.schema["seq"].dataType)).alias("seq"))


def unpacked(seq) -> Read:
    """The arrays of one packed read."""
    continuous = np.array([s["continuous"] for s in seq], np.float64).reshape(len(seq), CONTINUOUS)
    return Read(continuous, np.array([s["tokens"] for s in seq], np.int64), np.array([s["target"] for s in seq], np.int64))
