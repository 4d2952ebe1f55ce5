"""Result tables and files: samples, compact log, metrics CSV, JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualweave.constants import LN2
from qualweave.functions.predictor import floored
from qualweave.functions.symbols import decoded, quality_char
from qualweave.operators.split import nonempty


def sample_rows(scored: DataFrame, reads: DataFrame) -> DataFrame:
    """The fourteen sample columns of positions whose reads are given, at full precision.

    reads: the first reads of a split; read_in_sample counts those that aren't empty. The window is over the sample only.
    """
    numbered = nonempty(reads).select("file", "read_id", (F.row_number().over(Window.partitionBy("file").orderBy("read_id")) - 1).alias("read_in_sample"))
    predicted = decoded(F.col("q_hat"), F.col("pred_residual"))
    return scored.join(numbered, ["file", "read_id"]).select(
        "read_in_sample",
        F.col("pos").alias("position_in_read"),
        F.col("observed").alias("observed_id"),
        quality_char(F.col("observed")).alias("observed_char"),
        "q_hat",
        F.col("residual").alias("true_residual"),
        "pred_residual",
        predicted.alias("pred_quality"),
        quality_char(predicted).alias("pred_quality_char"),
        F.col("pred_prob").alias("pred_probability"),
        F.col("model_prob").alias("model_true_prob"),
        "model_bits",
        floored(F.col("p_true")).alias("h5_true_prob"),
        (-F.ln(floored(F.col("p_true"))) / LN2).alias("h5_bits"),
    )


def first_rows(scored: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n positions in file, read and place order; Spark plans a top-k, not a sort of all."""
    return scored.orderBy(*order).limit(n)


#: Splits a double into two halves of which products with short numbers are exact.
SPLITTER = float((1 << 27) + 1)
MILLION = 1_000_000.0
#: Values from here on are whole, and their digits are made limb by limb.
WIDE = float(1 << 62)
LIMB = 10**9


def decimals(value: Column) -> Column:
    """Six decimals as Python's format writes them: the double's exact value, rounded half to even.

    The fraction times a million is p + e exactly, p the rounded product and e its error, from
    halves of the fraction whose products with a million are exact. So the side of a half
    on which the value lies is known, and ties are ties of the value itself, not of its shortest
    decimal spelling.
    """
    x = value.cast("double")
    size = F.abs(x)
    whole = F.floor(F.when(size < WIDE, size).otherwise(F.lit(0.0)))
    fraction = F.when(size < WIDE, size - whole.cast("double")).otherwise(F.lit(0.0))
    p = fraction * MILLION
    high = SPLITTER * fraction - (SPLITTER * fraction - fraction)
    e = (high * MILLION - p) + (fraction - high) * MILLION
    n = F.floor(p)
    side = (p - n.cast("double")) - 0.5
    up = (side > 0) | (side == 0) & ((e > 0) | (e == 0) & (n % 2 == 1))
    n = n + up.cast("long")
    carried = n == int(MILLION)
    digits = F.concat((whole + carried.cast("long")).cast("string"), F.lit("."), F.lpad(F.when(carried, 0).otherwise(n).cast("string"), 6, "0"))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    special = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf")))
    return F.when(x.isNull(), F.lit(None)).when(special.isNotNull(), special).when(size < WIDE, F.concat(sign, digits)).otherwise(F.concat(sign, _wide(size), F.lit(".000000")))


def _wide(x: Column) -> Column:
    """Digits of a whole double of WIDE or more: its 53 bits as limbs of nine digits, lowest first, doubled as often as its exponent says."""
    bits = F.floor(F.log2(x)).cast("int") - 53
    bits = F.greatest(bits, F.lit(0))
    head = (x / F.pow(F.lit(2.0), bits.cast("double"))).cast("long")
    zero, limb = F.lit(0).cast("long"), F.lit(LIMB).cast("long")
    limbs = F.array(head % limb, F.floor(head / limb) % limb, F.floor(head / (limb * limb)).cast("long"))

    def times(a: Column, by: Column) -> Column:
        step = lambda acc, v: F.struct(F.concat(acc["out"], F.array((v * by + acc["over"]) % limb)).alias("out"), F.floor((v * by + acc["over"]) / limb).alias("over"))
        start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("over"))
        return F.aggregate(a, start, step, lambda acc: F.concat(acc["out"], F.array(acc["over"])))

    limbs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(bits / 20).cast("int"), F.lit(1))), limbs, lambda a, k: F.when(bits >= 20 * k, times(a, F.lit(1 << 20).cast("long"))).otherwise(a))
    limbs = times(limbs, F.pow(F.lit(2.0), (bits % 20).cast("double")).cast("long"))
    text = F.concat_ws("", F.transform(F.reverse(limbs), lambda v: F.lpad(v.cast("string"), 9, "0")))
    return F.regexp_replace(text, "^0+", "")


def compact_lines(scored: DataFrame) -> DataFrame:
    """line: {predicted id}{its character}{its probability}{true id}{its character}."""
    predicted = decoded(F.col("q_hat"), F.col("pred_residual"))
    parts = [predicted.cast("string"), quality_char(predicted), decimals(F.col("pred_prob")), F.col("observed").cast("string"), quality_char(F.col("observed"))]
    return scored.select("file", "read_id", "pos", F.concat(*[x for p in parts for x in (F.lit("{"), p, F.lit("}"))]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part with a header, doubled quotes and CRLF, as Python's csv writes it; for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_text(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def save_json(value: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8", newline="\n")
