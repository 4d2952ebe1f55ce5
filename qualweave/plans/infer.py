"""Scoring reads with the network: parameters are broadcast (their size is the model's), reads never cross tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.constants import LN2, SHIFT
from qualweave.errors import SequenceError
from qualweave.plans import network
from qualweave.plans.packing import unpacked

POSITION = "file string, read_id long, pos int, observed int, q_hat int, residual int, pred_residual int, pred_prob double, model_prob double, p_true double, true_freq double, model_bits double, baseline_bits double"


#: Reads that are scored before a task hands their positions on.
BATCH_READS = 128


def score(packed: DataFrame, config: network.Config, parameters: network.Parameters, batch_reads: int = BATCH_READS) -> DataFrame:
    """Positions with the true symbol's probability and the likeliest residual (the lowest of equals), ready for metrics and sinks.

    batch_reads bounds the memory of a task's output; results don't depend on it.
    """
    if batch_reads < 1:
        raise SequenceError("batch_reads must be positive")
    shared = packed.sparkSession.sparkContext.broadcast((config, parameters))

    def scored(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        config, parameters = shared.value
        done = []
        for pdf in source:
            for file, read_id, seq in zip(pdf["file"], pdf["read_id"], pdf["seq"], strict=True):
                read = unpacked(seq)
                logits, _ = network.forward(config, parameters, read)
                q_hat, rows = read.tokens[:, 0], np.arange(len(seq))
                logp = network.log_softmax(logits, q_hat)
                best = logp.argmax(axis=1)
                one = pd.DataFrame(
                    {
                        "file": file,
                        "read_id": read_id,
                        "pos": rows.astype(np.int32),
                        "observed": [s["observed"] for s in seq],
                        "q_hat": q_hat.astype(np.int32),
                        "residual": (read.targets - SHIFT).astype(np.int32),
                        "pred_residual": (best - SHIFT).astype(np.int32),
                        "pred_prob": np.exp(logp[rows, best]),
                        "model_prob": np.exp(logp[rows, read.targets]),
                        "p_true": [s["p_true"] for s in seq],
                        "true_freq": [float(s["true_freq"]) for s in seq],
                        "model_bits": -logp[rows, read.targets] / LN2,
                        "baseline_bits": -np.log2(np.maximum([s["p_true"] for s in seq], 1e-12)),
                    }
                )
                done.append(one)
                if len(done) == batch_reads:
                    yield pd.concat(done, ignore_index=True)
                    done = []
        if done:
            yield pd.concat(done, ignore_index=True)

    return packed.select("file", "read_id", "seq").mapInPandas(scored, POSITION)


def read_bits(scored: DataFrame) -> DataFrame:
    return scored.groupBy("file", "read_id").agg(F.count("*").alias("symbols"), F.sum("model_bits").alias("model_bits"), F.sum("baseline_bits").alias("baseline_bits"))
