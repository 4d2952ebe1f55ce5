"""Causal history within a read: previous symbols and hashed windows of buckets.

All lags share one window specification, so Spark plans one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from qualweave.constants import Q_BASE, Q_BOS, Q_BOS_BUCKET, Q_KS, R_BASE, R_BOS, R_BOS_BUCKET, R_KS, STRIDE, VOCAB
from qualweave.errors import SequenceError
from qualweave.functions.symbols import normal_ks, quality_bucket, residual_bucket


def read_window() -> WindowSpec:
    return Window.partitionBy("file", "read_id").orderBy("pos")


def previous(df: DataFrame) -> DataFrame:
    """Adds prev_q and prev_r, the observed id and target class one place before."""
    w = read_window()
    return df.withColumns({"prev_q": F.lag("observed", 1, Q_BOS).over(w), "prev_r": F.lag("target", 1, R_BOS).over(w)})


def token(bucket: str, k: int, stride: int, base: int, bos: int, vocab: int) -> Column:
    """The k buckets at distances k * stride to stride before, oldest first, as digits of a number modulo vocab."""
    w, code = read_window(), F.lit(0).cast("long")
    for step in range(k, 0, -1):
        code = (code * base + F.lag(bucket, step * stride, bos).over(w)) % vocab
    return code.cast("int")


def tokens(df: DataFrame, kind: str, ks: Iterable[int] | None = None, stride: int = STRIDE, vocab: int = VOCAB) -> DataFrame:
    """Adds qmer_0, qmer_1, ... (kind q, needs observed) or rmer_0, ... (kind r, needs residual), one for each window length."""
    default, base, bos, bucket = (Q_KS, Q_BASE, Q_BOS_BUCKET, quality_bucket(F.col("observed"))) if kind == "q" else (R_KS, R_BASE, R_BOS_BUCKET, residual_bucket(F.col("residual")))
    ks = normal_ks(default if ks is None else ks)
    if not ks:
        return df
    if stride <= 0 or vocab <= 0:
        raise SequenceError("stride and vocabulary size must be positive")
    name = f"{kind}_bucket"
    df = df.withColumn(name, bucket)
    return df.withColumns({f"{kind}mer_{i}": token(name, k, stride, base, bos, vocab) for i, k in enumerate(ks)})


def attention_span(length: Column, context: int) -> Column:
    """Sum over a read's places of min(pos + 1, context), in closed form."""
    n = length.cast("long")
    return F.when(n <= context, F.expr("0L") + n * (n + 1) / 2).otherwise(context * (context + 1) / 2 + (n - context) * context).cast("long")
