"""Blocks of integer vectors, and the meeting of query rows with them.

A block is one row that holds at most about so many vectors as a matrix, so a task works
on dense arrays of a known size and a shuffle moves few large rows. Which rows share a
block never changes a result, only the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def scaled(vec: Column, scale: int) -> Column:
    """Each component as floor(scale * x), x as double; saturates at the limits of long."""
    return F.transform(vec, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))


def usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    return vec.isNotNull() & F.coalesce(F.forall(vec, finite), F.lit(False))


def stacked(rows: Iterable[np.ndarray]) -> np.ndarray:
    """Vectors as one matrix of long; shorter ones end in zeros."""
    rows = list(rows)
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for r, values in zip(out, rows, strict=True):
        r[: len(values)] = values
    return out


def to_bytes(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest integer type that holds x, and x in it."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def from_bytes(kind: str, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.int64)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return pad(a), pad(b)


def fits_double(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of a product of a row of a and one of b is exact in doubles."""
    top = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    return top(a) * top(b) * max(1, a.shape[1]) < 1 << 52


def wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of values that doubles can't hold, saturated at the limits of long."""
    whole = a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(whole, -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def best_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each owner: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    first = np.searchsorted(owner, owner)
    return order[np.arange(len(order)) - first < k]


def met(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows of a tile, its block) for each pair (tile, block); a task holds one tile and one block at a time."""
    left, right = pairs.join(queries, "tile"), pairs.join(blocks, "block")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from pairs
    names = [c.split()[0] for c in schema.split(", ")]

    def both(tile: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        # A pair can have no query left.
        return work(tile, block) if len(tile) and len(block) else pd.DataFrame({c: [] for c in names})

    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(both, schema)


def numbered(headers: DataFrame, tiles: int) -> DataFrame:
    """(tile, block) for all tiles 0 to tiles - 1 and all blocks: the query set against all rows, in blocks."""
    return headers.select("block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
