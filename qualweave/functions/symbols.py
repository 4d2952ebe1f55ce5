"""Scalar expressions of ids, residuals and places."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualweave.constants import CLASSES, LENGTH_CAP, MAX_ID, SHIFT
from qualweave.errors import SequenceError

#: Upper bounds of the buckets of quality ids; the last bucket is open.
QUALITY_BOUNDS = (9, 19, 24, 29, 34, 39)


#: Rules that expressions check as they are evaluated; their errors begin with these names.
INVARIANTS = ("observed_range", "residual_class", "row_alignment", "alphabet_width")


def checked(value: Column, ok: Column, rule: str, kind: str) -> Column:
    """value where ok, else an error that names the rule and the value: a run checks what it reads, without a scan of its own."""
    message = F.concat(F.lit(f"{rule}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(ok, value).otherwise(F.raise_error(message).cast(kind))


def checked_id(observed: Column) -> Column:
    return checked(observed, observed.between(0, MAX_ID), "observed_range", "int")


def checked_class(target_: Column) -> Column:
    return checked(target_, target_.between(0, CLASSES - 1), "residual_class", "int")


def residual(observed: Column, q_hat: Column) -> Column:
    return observed - q_hat


def target(residual_: Column) -> Column:
    return residual_ + SHIFT


def quality_bucket(q: Column) -> Column:
    out = F.lit(len(QUALITY_BOUNDS))
    for k in range(len(QUALITY_BOUNDS) - 1, -1, -1):
        out = F.when(q <= QUALITY_BOUNDS[k], k).otherwise(out)
    return out.cast("int")


def residual_bucket(r: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(0), r + 5)).cast("int")


def relative_position(pos: Column, length: Column) -> Column:
    return pos / F.greatest(length - 1, F.lit(1))


def length_norm(length: Column) -> Column:
    return F.least(length, F.lit(LENGTH_CAP)) / LENGTH_CAP


def decoded(q_hat: Column, predicted_residual: Column) -> Column:
    return F.least(F.lit(MAX_ID), F.greatest(F.lit(0), q_hat + predicted_residual)).cast("int")


def quality_char(q: Column) -> Column:
    return F.chr(q + 33)


def legal(q_hat: Column) -> Column:
    """Array over the residual classes: whether q_hat plus the residual is an id."""
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: (q_hat + c - SHIFT).between(0, MAX_ID))


def six(v: float) -> str:
    """Six decimals as Python writes them, for sinks that pass rows through the driver."""
    return f"{v:.6f}"


def parse_ks(text: str) -> tuple[int, ...]:
    """A comma-separated list of positive window lengths; blanks are skipped."""
    out = tuple(int(p) for p in map(str.strip, text.split(",")) if p)
    if any(k <= 0 for k in out):
        raise SequenceError(f"window lengths must be positive: {text}")
    return out


def normal_ks(ks: Iterable[int] | None) -> tuple[int, ...]:
    """Positive lengths in the order given, repeats kept."""
    return tuple(int(k) for k in ks or () if int(k) > 0)
