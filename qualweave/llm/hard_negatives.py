"""Hard negatives by threshold joins over a pruned inverted index.

For each anchor and each of its nearest rows of the same label (positives), the rows of other
labels come whose score lies in a window under the positive's score, best first.

Threshold join. Dimensions are taken in one order, those of most energy first. A row's suffix,
from the first dimension on where its norm times an anchor's norm is under the threshold, can
lift no pair over the threshold by itself and isn't indexed. Rows of a block are sorted by how
many dimensions they index, so the posting list of a dimension is a beginning of that order,
and a run of dimensions is scored for all anchors of a tile by one product. After each run
a pair goes if its partial score and the product of the remaining norms stay under the
anchor's threshold; what the index left out is added for the rows that still have a pair.

Lowering. A join at a high threshold finds everything above it. Anchors (and windows) that have
enough rows by then are done and exact; only the others go on to the next, lower threshold, and
the last one is the end of the window, or none. The number of rounds is fixed; each emits at
most as many rows for each block and window as the window takes.

Positives are sought among the blocks that hold the anchor's label; negatives among
all others. Crowded labels have many blocks, sparse ones share some.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part; a row isn't its own positive, but other rows of its id can be; each row of a repeated
anchor id mines for itself; a shorter vector counts as if it ended in zeros; products beyond
long saturate; a negative positive score has an empty window; an anchor without positives
gives no row; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualweave.llm import vector_blocks as vb
from qualweave.llm.graphs import sized
from qualweave.session import cut, saved

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: The window in hundredths of the positive's score.
LOW, HIGH = 30, 90
ROWS = 4096
TILE = 1024
#: Dimensions scored between two looks at the remaining norms.
RUN = 8
#: Thresholds of positives, in parts of the anchor's norm times the largest norm; the last round has none.
FALLS = (0.8, 0.5, 0.3, 0.1, None)
#: Thresholds of negatives, in parts of the window's upper end; the last round takes the lower end.
WINDOW_FALLS = (0.8, 0.6, None)
LEAST = np.iinfo(np.int64).min


class Index:
    """Rows of a block, dimensions in the given order, with suffixes left out that can't reach the ratio of threshold and anchor norm."""

    def __init__(self, x: np.ndarray, order: np.ndarray, ratio: float) -> None:
        x = x[:, order].astype(np.float64)
        # suffix[:, d] is the norm of dimensions d and after.
        suffix = np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
        self.suffix = np.concatenate([suffix, np.zeros((len(x), 1))], axis=1)
        covered = self.suffix * (1 + 1e-9) < ratio if ratio > 0 else np.zeros_like(self.suffix, bool)
        self.kept = np.where(covered.any(1), covered.argmax(1), x.shape[1])
        self.place = np.argsort(-self.kept, kind="stable")
        self.x, self.kept, self.suffix = x[self.place], self.kept[self.place], self.suffix[self.place]
        self.indexed = np.where(np.arange(x.shape[1]) < self.kept[:, None], self.x, 0)

    def pairs(self, q: np.ndarray, order: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in q and in the block, and scores, of all pairs of at least least[i]."""
        q = q[:, order].astype(np.float64)
        width = q.shape[1]
        rest = np.sqrt(np.maximum(np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1], 0))
        rest = np.concatenate([rest, np.zeros((len(q), 1))], axis=1)
        rows = np.arange(len(self.x))
        score = np.zeros((len(q), len(rows)))
        for d in range(0, width, RUN):
            upto = min(d + RUN, width)
            listed = int(np.searchsorted(-self.kept[rows], -d, "left"))
            if listed:
                score[:, :listed] += q[:, d:upto] @ self.indexed[rows[:listed], d:upto].T
            # Rows whose index ended before have all of their suffix left.
            left = np.minimum(self.kept[rows], upto)
            most = score + rest[:, left] * self.suffix[rows, left]
            open_ = (most * (1 + np.sign(most) * 1e-9) + 1e-6 >= least[:, None]).any(0)
            if not open_.all():
                rows, score = rows[open_], score[:, open_]
            if not len(rows):
                break
        ended = self.kept[rows] < width
        if ended.any():
            score[:, ended] += q @ (self.x - self.indexed)[rows[ended]].T
        i, j = np.nonzero(score >= least[:, None])
        return i, self.place[rows[j]], score[i, j].astype(np.int64)


def threshold_pairs(q: np.ndarray, least: np.ndarray, x: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and x and inner products of all pairs whose product is at least least[i]."""
    q, x = vb.same_width(q, x)
    if not len(q) or not len(x):
        return (np.zeros(0, np.int64),) * 3
    if not vb.fits_double(q, x):
        score = vb.wide_products(q, x)
        i, j = np.nonzero(score >= least[:, None])
        return i, j, score[i, j]
    order = np.concatenate([order[order < q.shape[1]], np.setdiff1d(np.arange(q.shape[1]), order)]).astype(np.int64)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(norm > 0, least / norm, np.where(least > 0, np.inf, -np.inf)).min()
    return Index(x, order, float(ratio)).pairs(q, order, least)


def _dealt(base: DataFrame, name: str, rows: int) -> DataFrame:
    """base with a column name, block numbers: of labels with more rows several blocks, of sparse labels one for many."""
    counts = base.groupBy("label").agg(F.count("*").alias("n"))
    counts = cut(counts.select("label", F.ceil(F.col("n") / rows).alias("parts"), "n"))
    sparse = counts.where("parts = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    shared = max(1, math.ceil(sparse / rows))
    # Blocks of crowded labels are odd and told apart by label and part, those of sparse ones even.
    crowded = F.xxhash64("label", F.pmod(F.monotonically_increasing_id(), F.col("parts"))).bitwiseOR(F.lit(1))
    block = F.when(F.col("parts") > 1, crowded).otherwise(F.pmod(F.xxhash64("label"), F.lit(shared)) * 2)
    return base.join(sized(counts.select("label", "parts")), "label").withColumn(name, block).drop("parts")


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, rows: int = ROWS, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors whose id is divisible by every."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vb.usable(F.col("v")))
    base = cut(base.select("id", "label", vb.scaled(F.col("v"), scale).alias("x")).withColumn("row", F.monotonically_increasing_id()))
    energy = base.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("e")).collect()
    order = np.array([r["d"] for r in sorted(energy, key=lambda r: (-r["e"], r["d"]))], np.int64)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v))
    top = base.agg(F.max(norm).alias("m")).first()["m"] or 0.0

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "id", "row"], kind="stable")
        kind, raw = vb.to_bytes(vb.stacked(pdf["x"]))
        longs = [pdf[c].to_numpy(np.int64).tobytes() for c in ("id", "label", "row")]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), len(pdf), kind, raw, *longs)], columns=["block", "n", "kind", "x", "ids", "labels", "rows"])

    blocks = saved(_dealt(base, "block", rows).groupBy("block").applyInPandas(packed, "block long, n int, kind string, x binary, ids binary, labels binary, rows binary"))
    anchors = cut(base.where(F.col("id") % every == 0))
    near = cut(_positives(anchors, blocks, order, top, positives, tile))
    return _negatives(anchors, near, blocks, order, negatives, low, high, tile)


def _given(work, fall: float | None):
    return lambda left, block: work(fall, left, block)


def _unpacked(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    b = block.iloc[0]
    return (vb.from_bytes(b["kind"], b["x"], b["n"]), *(np.frombuffer(b[c], np.int64) for c in ("ids", "labels", "rows")))


def _positives(anchors: DataFrame, blocks: DataFrame, order: np.ndarray, top: float, k: int, tile: int) -> DataFrame:
    """row, place (from 1), positive_id, score: the k best other rows of each anchor's label."""

    def labels_of(source):
        for pdf in source:
            for block, raw in zip(pdf["block"], pdf["labels"], strict=True):
                yield pd.DataFrame({"block": block, "label": np.unique(np.frombuffer(raw, np.int64))})

    held = cut(blocks.select("block", "labels").mapInPandas(labels_of, "block long, label long"))
    open_, done = cut(_dealt(anchors, "tile", tile)), None
    best = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")

    def work(fall: float | None, left: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        x, ids, labels, rows = _unpacked(block)
        out = []
        for label, own in left.groupby("label"):
            a, b = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            q = vb.stacked(own["x"])
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            least = np.full(len(q), float(LEAST)) if fall is None else np.ceil(fall * top * norm)
            i, j, score = threshold_pairs(q, least, x[a:b], order)
            row = own["row"].to_numpy(np.int64)
            other = row[i] != rows[a:b][j]
            i, j, score = i[other], j[other], score[other]
            pick = vb.best_of(i, score, ids[a:b][j], k)
            out.append(pd.DataFrame({"row": row[i[pick]], "positive_id": ids[a:b][j[pick]], "score": score[pick]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("row", "positive_id", "score")})

    for fall in FALLS:
        pairs = open_.select("tile", "label").distinct().join(held, "label").select("tile", "block").distinct()
        found = vb.met(pairs, open_, blocks, _given(work, fall), "row long, positive_id long, score long")
        found = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k))
        if fall is not None:
            full = cut(found.where(F.col("place") == k).select("row"))
            open_ = cut(open_.join(sized(full), "row", "left_anti"))
            found = found.join(sized(full), "row", "left_semi")
        done = found if done is None else done.unionByName(found)
        if fall is not None and open_.isEmpty():
            break
    return done


def _negatives(anchors: DataFrame, near: DataFrame, blocks: DataFrame, order: np.ndarray, k: int, low: int, high: int, tile: int) -> DataFrame:
    """For each anchor row and positive the k best rows of other labels with low to high hundredths of the positive's score."""

    def hundredths(score: np.ndarray, part: int, up: bool) -> np.ndarray:
        """floor or ceiling of part * score / 100 without overflow; score is not negative."""
        whole, rest = np.divmod(score, 100)
        return whole * part + (rest * part + (99 if up else 0)) // 100

    tiles = max(1, math.ceil(anchors.count() / tile))
    pairs = cut(vb.numbered(blocks, tiles))
    open_, done = cut(near.where("score >= 0").select("row", "place", "score")), None
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")

    def work(fall: float | None, left: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        x, ids, labels, _ = _unpacked(block)
        q, row, own = vb.stacked(left["x"]), left["row"].to_numpy(np.int64), left["label"].to_numpy(np.int64)
        at = np.repeat(np.arange(len(left)), [len(v) for v in left["places"]])
        place, score = (np.concatenate(left[c].to_list()).astype(np.int64) for c in ("places", "scores"))
        lo, hi = hundredths(score, low, True), hundredths(score, high, False)
        if fall is not None:
            lo = np.maximum(lo, np.ceil(fall * hi).astype(np.int64))
        least = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(least, at, lo)
        i, j, found = threshold_pairs(q, least.astype(np.float64), x, order)
        other = own[i] != labels[j]
        i, j, found = i[other], j[other], found[other]
        begin, end = np.searchsorted(i, np.arange(len(q))), np.searchsorted(i, np.arange(len(q)), "right")
        of, chosen = [], []
        for w, (a, lo_w, hi_w) in enumerate(zip(at, lo, hi, strict=True)):
            f = found[begin[a] : end[a]]
            inside = np.flatnonzero((f >= lo_w) & (f <= hi_w)) + begin[a]
            inside = inside[np.lexsort((ids[j[inside]], -found[inside]))[:k]]
            of.append(np.full(len(inside), w))
            chosen.append(inside)
        w, chosen = np.concatenate(of), np.concatenate(chosen)
        return pd.DataFrame({"row": row[at[w]], "place": place[w], "negative_id": ids[j[chosen]], "negative_score": found[chosen]})

    for fall in WINDOW_FALLS:
        windows = open_.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("w")).select("row", F.col("w.place").alias("places"), F.col("w.score").alias("scores"))
        queries = anchors.join(windows, "row").withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"))
        found = vb.met(pairs, queries, blocks, _given(work, fall), "row long, place int, negative_id long, negative_score long")
        found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if fall is not None:
            full = cut(found.where(F.col("rank") == k).select("row", "place"))
            open_ = cut(open_.join(sized(full), ["row", "place"], "left_anti"))
            found = found.join(sized(full), ["row", "place"], "left_semi")
        done = found if done is None else done.unionByName(found)
        if fall is not None and open_.isEmpty():
            break
    names = near.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("row", "place", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return done.join(names, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
