"""Training: sampled blocks of reads, gradients summed where the reads lie, one AdamW step on the driver.

A step moves the parameters to the tasks and one gradient a task back; both are as
large as the model, whatever the corpus.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from qualweave.constants import LN2, SEED, TRAIN_FRACTION
from qualweave.errors import SequenceError
from qualweave.functions.predictor import described as describe
from qualweave.operators import metrics, sampler, split
from qualweave.plans import infer, network
from qualweave.plans.packing import packed, unpacked
from qualweave.sources.views import Sequences, predictors


class AdamW:
    def __init__(self, parameters: network.Parameters, rate: float, decay: float) -> None:
        self.rate, self.decay, self.steps = rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, parameters: network.Parameters, gradients: network.Parameters) -> None:
        self.steps += 1
        for k, g in gradients.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.steps), self.v[k] / (1 - 0.999**self.steps)
            parameters[k] = parameters[k] * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)

    def state(self) -> network.Parameters:
        return {f"m/{k}": v for k, v in self.m.items()} | {f"v/{k}": v for k, v in self.v.items()}


def clip(gradients: network.Parameters, most: float) -> None:
    """Scales gradients whose common norm exceeds most; 0 leaves them."""
    size = float(np.sqrt(sum((g * g).sum() for g in gradients.values())))
    if most > 0 and size > most:
        for k in gradients:
            gradients[k] = gradients[k] * (most / (size + 1e-6))


def step_gradients(reads: DataFrame, config: network.Config, parameters: network.Parameters) -> tuple[float, int, float, network.Parameters]:
    """Summed loss, symbols, baseline bits and the mean gradient of packed reads."""
    shared = reads.sparkSession.sparkContext.broadcast((config, parameters))
    names = sorted(parameters)

    def summed(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        config, parameters = shared.value
        total = np.zeros(sum(parameters[n].size for n in names))
        loss, count, base = 0.0, 0, 0.0
        for pdf in source:
            for seq in pdf["seq"]:
                nats, g = network.loss_and_gradients(config, parameters, unpacked(seq))
                total += np.concatenate([g[n].ravel() for n in names])
                loss, count = loss + nats, count + len(seq)
                base -= float(np.log2(np.maximum([s["p_true"] for s in seq], 1e-12)).sum())
        if count:
            yield pd.DataFrame({"loss": [loss], "symbols": [count], "base": [base], "g": [total]})

    rows = reads.select("seq").mapInPandas(summed, "loss double, symbols long, base double, g array<double>").collect()
    shared.destroy()
    symbols = sum(r.symbols for r in rows)
    flat = np.sum([r.g for r in rows], axis=0) / symbols
    ends = np.cumsum([parameters[n].size for n in names])
    gradients = {n: part.reshape(parameters[n].shape) for n, part in zip(names, np.split(flat, ends[:-1]), strict=True)}
    return sum(r.loss for r in rows), symbols, sum(r.base for r in rows), gradients


def train(view: Sequences, out: str | Path, config: network.Config | None = None, epochs: int = 5, steps: int = 1000, batch_reads: int = 64, eval_reads: int | None = 5000, fraction: float = TRAIN_FRACTION, rate: float = 1e-3, decay: float = 1e-5, grad_clip: float = 1.0, seed: int = SEED, every_epoch: bool = False, report: Callable[[dict], None] | None = None, eval_batch_reads: int = infer.BATCH_READS) -> list[dict]:
    """The training log, each row of which is also handed to report as its epoch ends. Checkpoints: best (least validation bits, the earliest of equals) and, on request, each epoch.

    Dropout isn't applied. A validation of NaN raises, as no epoch could then be the best.
    """
    if not 0 < fraction < 1:
        raise SequenceError("train fraction must be in (0, 1)")
    config = config or network.Config()
    spark = view.reads.sparkSession
    parameters = network.create(config, seed)
    optimizer = AdamW(parameters, rate, decay)
    vectors = None if view.own_counts else describe(predictors(view, fraction)).cache()
    blocks = sampler.plan(spark, view.reads, epochs * steps, batch_reads, fraction, seed).collect()
    log, best = [], float("inf")
    for epoch in range(1, epochs + 1):
        began, total, count, base = time.time(), 0.0, 0, 0.0
        for block in blocks[(epoch - 1) * steps : epoch * steps]:
            one = spark.createDataFrame([(block.file, block.start, block.stop)], "file string, start long, stop long")
            loss, n, b, gradients = step_gradients(packed(view, vectors, config, one), config, parameters)
            clip(gradients, grad_clip)
            optimizer.step(parameters, gradients)
            total, count, base = total + loss, count + n, base + b
        test = packed(view, vectors, config, split.bounds(view.reads, "test", fraction, eval_reads or None))
        val = metrics.require_symbols(metrics.compression(infer.score(test, config, parameters, eval_batch_reads), by_file=False))[0].asDict()
        if np.isnan(val["model_avg_bits_per_quality"]):
            raise SequenceError(f"epoch {epoch}: validation gave NaN")
        log.append(
            {
                "epoch": epoch,
                "train_bits_per_quality": total / count / LN2,
                "train_h5_baseline_bits": base / count,
                "val_model_avg_bits_per_quality": val["model_avg_bits_per_quality"],
                "val_h5_baseline_avg_bits_per_quality": val["h5_baseline_avg_bits_per_quality"],
                "val_delta_bits": val["delta_bits"],
                "val_relative_improvement": val["relative_improvement"],
                "val_total_symbols": val["total_symbols"],
                "val_zero_true_freq": val["zero_true_freq"],
                "elapsed_seconds": time.time() - began,
            }
        )
        if report:
            report(log[-1])
        if every_epoch:
            network.save(Path(out) / f"epoch_{epoch}", config, parameters, epoch, val, optimizer.state())
        if val["model_avg_bits_per_quality"] < best:
            best = val["model_avg_bits_per_quality"]
            network.save(Path(out) / "best", config, parameters, epoch, val, optimizer.state())
    if vectors is not None:
        vectors.unpersist()
    return log
