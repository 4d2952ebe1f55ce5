"""Exact top-k search by inner product, with segment statistics from coarse to fine.

A vector is cut into 1, 2, 4, ... segments of neighbouring components. With means m and
deviations s of a segment of l components, the squared distance of two vectors is at least
the sum of l * ((m1 - m2)^2 + (s1 - s2)^2), by Cauchy and Schwarz within each segment; as
2 * product = |q|^2 + |x|^2 - distance^2, that is a product of at most the sum of
l * (m1 * m2 + s1 * s2). Each level halves the segments of the one before and never loosens
the bound. A candidate goes as soon as a level shows that it can't reach a query's k-th best;
exact products are computed for the survivors of the finest level.

Vectors lie in blocks by the signs of their coarse segment means; a crowded sign pattern is
split into many blocks, sparse ones share one. Within its own block each query finds k
candidates, whose worst is the threshold that it takes to all other blocks, so other
blocks return little. Tiles of queries meet blocks pairwise; the memory of a task is one tile
and one block, at any size of the corpus.

Defined cases: rows with a null id or vector, or a null or non-finite component, take no part;
a row never is its own candidate, but other rows of the same id are; each row of a repeated
query id gets a ranking of its own; a shorter vector counts as if it ended in zeros; an empty
vector scores 0; products beyond long saturate; fewer than k candidates give all there are; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualweave.llm import vector_blocks as vb
from qualweave.session import cut, saved

K = 20
SCALE = 64
EVERY = 20
#: Vectors of a block, and blocks whose queries make a tile.
ROWS = 4096
TILE_BLOCKS = 16
#: Queries that walk through the levels together.
STRIP = 256
#: Sign bits of the block key: segment sums of 1, 2, 4 and 8 segments but for the last of each halving, which says least.
KEY_SEGMENTS = 8


def levels(x: np.ndarray) -> list[np.ndarray]:
    """Segment statistics of each row, coarse to fine: the product of two rows of one level bounds their inner product."""
    n, width = x.shape
    x, out, segments = x.astype(np.float64), [], 1
    while width and segments <= max(1, width // 2):
        edge = np.linspace(0, width, segments + 1).astype(int)
        size = np.diff(edge).astype(np.float64)
        mean = np.add.reduceat(x, edge[:-1], axis=1) / size
        spread = x - np.repeat(mean, np.diff(edge), axis=1)
        deviation = np.sqrt(np.add.reduceat(spread * spread, edge[:-1], axis=1) / size)
        out.append(np.concatenate([mean * np.sqrt(size), deviation * np.sqrt(size)], axis=1))
        segments *= 2
    return out


def search(q: np.ndarray, least: np.ndarray, least_id: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of x for each row of q that can be among the k best at all: places in q and x, and products.

    least, least_id: score and id of the k-th best known so far (the score -inf if there are
    fewer). own: the row of x that a query is itself, or -1.
    """
    q, x = vb.same_width(q, x)
    none = np.zeros(0, np.int64)
    if not len(q) or not len(x):
        return none, none, none
    exact = vb.fits_double(q, x)
    lq, lx = (levels(q), levels(x)) if exact else ([], [])
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    nq, nx = np.sqrt((fq * fq).sum(1)), np.sqrt((fx * fx).sum(1))
    out = []
    for a in range(0, len(q), STRIP):
        rows = slice(a, a + STRIP)
        floor, floor_id = least[rows, None], least_id[rows, None]
        cols = np.arange(len(x))
        alive = cols[None, :] != own[rows, None]
        for cq, cx in zip(lq, lx, strict=True):
            # Rounding can take a bound under the product by far less than this.
            most = np.floor(cq[rows] @ cx[cols].T + 1e-9 * nq[rows, None] * nx[None, cols] + 1e-6)
            alive &= (most > floor) | (most == floor) & (ids[None, cols] < floor_id)
            some = alive.any(0)
            if some.mean() < 0.8:
                cols, alive = cols[some], alive[:, some]
            if not len(cols):
                break
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if not exact:
            score = vb.wide_products(q[rows], x[cols])[i, j]
        elif len(i) > 0.1 * alive.size:
            score = (fq[rows] @ fx[cols].T)[i, j].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("nd,nd->n", fq[rows][i[s : s + 65536]], fx[cols[j[s : s + 65536]]]) for s in range(0, len(i), 65536)]).astype(np.int64)
        j = cols[j]
        good = (score > floor[i, 0]) | (score == floor[i, 0]) & (ids[j] < floor_id[i, 0])
        i, j, score = i[good], j[good], score[good]
        top = vb.best_of(i, score, ids[j], k)
        out.append((i[top] + a, j[top], score[top]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else (none, none, none)


def _key(x: Column) -> Column:
    """Signs of the sums of 1, 2, 4 and KEY_SEGMENTS segments, coarse first, as one number."""
    bits, segments = F.lit(0), 1
    while segments <= KEY_SEGMENTS:
        size = F.ceil(F.size(x) / segments).cast("int")
        for s in range(segments - 1 if segments > 1 else 1):
            total = F.aggregate(F.slice(x, size * s + 1, size), F.lit(0.0), lambda acc, v: acc + v)
            bits = bits * 2 + (total >= 0).cast("int")
        segments *= 2
    return bits


def _block(counts: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """(key, first block, blocks) of each key: crowded keys have several blocks, neighbouring sparse ones share one."""
    out, block, held = [], 0, 0
    for key, n in sorted(counts.items()):
        parts = -(-n // rows)
        if held and (parts > 1 or held + n > rows):
            block, held = block + 1, 0
        out.append((key, block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose id is divisible by every."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & vb.usable(F.col("v")))
    base = cut(base.select("id", vb.scaled(F.col("v"), scale).alias("x")).withColumn("key", _key(F.col("x"))))
    # At most 2^12 sign patterns, whatever the corpus.
    plan = _block({r["key"]: r["n"] for r in base.groupBy("key").agg(F.count("*").alias("n")).collect()}, rows)
    names = base.sparkSession.createDataFrame(plan or [(0, 0, 1)], "key int, first int, parts int")
    dealt = base.join(F.broadcast(names), "key").select("id", "x", (F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("parts"))).alias("block"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block, its queries, and the k best of each within the block."""
        pdf = pdf.sort_values("id", kind="stable")
        ids, x = pdf["id"].to_numpy(np.int64), vb.stacked(pdf["x"])
        at = np.flatnonzero(ids % every == 0)
        i, j, score = search(x[at], np.full(len(at), -np.inf), np.full(len(at), vb.LONG_MAX), x, ids, at, k)
        least, least_id = np.full(len(at), -np.inf), np.full(len(at), vb.LONG_MAX)
        full = np.flatnonzero(np.bincount(i, minlength=len(at)) == k)
        last = np.searchsorted(i, full, "right") - 1
        least[full], least_id[full] = score[last], ids[j[last]]
        kind, raw = vb.to_bytes(x)
        q_kind, q_raw = vb.to_bytes(x[at])
        row = (int(pdf["block"].iloc[0]), len(ids), kind, ids.tobytes(), raw, len(at), q_kind, ids[at].tobytes(), at.tobytes(), q_raw, least.tobytes(), least_id.tobytes(), at[i].tobytes(), ids[j].tobytes(), score.tobytes())
        return pd.DataFrame([row], columns=_NAMES)

    blocks = saved(dealt.groupBy("block").applyInPandas(packed, _BLOCK))
    count = blocks.count()
    tiles = max(1, math.ceil(count / TILE_BLOCKS))

    def first(source):
        for pdf in source:
            for r in pdf.itertuples(index=False):
                at, vec, score = (np.frombuffer(b, np.int64) for b in (r.top_at, r.top_ids, r.top_scores))
                own = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"block": r.block, "at": at, "query_id": own[at], "vec_id": vec, "score": score})

    def further(tile: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        ids, x = np.frombuffer(b["ids"], np.int64), vb.from_bytes(b["kind"], b["x"], b["n"])
        out = []
        for r in tile.itertuples(index=False):
            if r.home == b["block"] or not r.q_n:
                continue
            q_ids, at, least, least_id = (np.frombuffer(v, t) for v, t in ((r.q_ids, np.int64), (r.q_at, np.int64), (r.least, np.float64), (r.least_id, np.int64)))
            i, j, score = search(vb.from_bytes(r.q_kind, r.q_x, r.q_n), least, least_id, x, ids, np.full(r.q_n, -1), k)
            out.append(pd.DataFrame({"block": r.home, "at": at[i], "query_id": q_ids[i], "vec_id": ids[j], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("block", "at", "query_id", "vec_id", "score")})

    found = "block long, at long, query_id long, vec_id long, score long"
    here = blocks.select("block", "ids", "top_at", "top_ids", "top_scores").mapInPandas(first, found)
    tiled = blocks.select(F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int").alias("tile"), F.col("block").alias("home"), "q_n", "q_kind", "q_ids", "q_at", "q_x", "least", "least_id")
    there = vb.met(vb.numbered(blocks, tiles), tiled, blocks.select("block", "n", "kind", "ids", "x"), further, found)
    by = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return here.unionByName(there).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_BLOCK = (
    "block long, n int, kind string, ids binary, x binary, q_n int, q_kind string, q_ids binary, q_at binary, "
    "q_x binary, least binary, least_id binary, top_at binary, top_ids binary, top_scores binary"
)
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
