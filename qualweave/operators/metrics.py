"""Compression metrics, epoch averages and the choice of a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from qualweave.errors import NoReads


def compression(df: DataFrame, by_file: bool = True) -> DataFrame:
    """Metrics of positions with model_bits, baseline_bits, true_freq; a group a file, or one for all.

    A baseline of 0 bits gives a null improvement.
    """
    groups = ["file"] if by_file else []
    out = df.groupBy(*groups).agg(
        F.count("*").alias("total_symbols"),
        F.sum("model_bits").alias("model_total_bits"),
        F.sum("baseline_bits").alias("h5_baseline_total_bits"),
        F.sum((F.col("true_freq") <= 0).cast("long")).alias("zero_true_freq"),
    )
    model, base = F.col("model_total_bits") / F.col("total_symbols"), F.col("h5_baseline_total_bits") / F.col("total_symbols")
    out = out.where("total_symbols > 0").withColumns({"model_avg_bits_per_quality": model, "h5_baseline_avg_bits_per_quality": base})
    model, base = F.col("model_avg_bits_per_quality"), F.col("h5_baseline_avg_bits_per_quality")
    return out.select(*groups, "total_symbols", "model_total_bits", model, "h5_baseline_total_bits", base, (model - base).alias("delta_bits"), F.try_divide(base - model, base).alias("relative_improvement"), "zero_true_freq")


def require_symbols(metrics: DataFrame) -> list[Row]:
    """The rows, one a file or one for all, from one run of what they are made of."""
    rows = metrics.collect()
    if not rows:
        raise NoReads("evaluation split produced zero symbols")
    return rows


def epoch_average(steps: DataFrame) -> DataFrame:
    """epoch, symbols, train_bits, train_baseline_bits from steps (epoch, loss in nats a symbol, symbols, baseline_bits)."""
    return steps.groupBy("epoch").agg(
        F.sum("symbols").alias("symbols"),
        (F.sum(F.col("loss") * F.col("symbols")) / F.sum("symbols") / F.ln(F.lit(2.0))).alias("train_bits"),
        (F.sum("baseline_bits") / F.sum("symbols")).alias("train_baseline_bits"),
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """epoch, val_bits of the earliest epoch with the least value; NaN never wins, so there may be no row."""
    return log.where(~F.isnan("val_bits") & F.col("val_bits").isNotNull()).orderBy("val_bits", "epoch").limit(1).select("epoch", "val_bits")
