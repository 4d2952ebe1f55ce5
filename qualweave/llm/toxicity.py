"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams that it contains (presence,
lower-cased, lengths 3 to 6). Each is scaled by the log ratio of its smoothed
document counts in the two classes, the vector is damped by the root of its length,
and a logistic regression on those values gives the score.

The classifier is fitted on at most FIT_ROWS labelled rows, chosen by a hash of
the id; every document is scored over its whole text. Label, language, source and
id are no inputs of a score.

Defined cases: null text is empty, and an empty text scores by the bias alone;
a null or missing label leaves the row out of the fit; of rows that repeat a label
the largest counts; of texts that share a labelled id one is fitted; without labelled
rows of both classes every score is 0.0; a text is read whole, in slices of SLICE
characters that overlap; an empty table gives an empty result; other columns are
carried by drop_toxic, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.llm.graphs import free

FIT_ROWS = 10_000
BUCKETS = 1 << 18
NGRAMS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.02, 1e-3
THRESHOLD = 0.5
SLICE = 1 << 20


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    fitted: bool = True


class Features:
    """Distinct n-gram buckets of a text. Holds one reusable table of 2**18 marks."""

    def __init__(self) -> None:
        self.mark = np.zeros(BUCKETS, np.int32)

    def _hashed(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        acc, out = a * np.uint32(0x9E3779B1), []
        for n in range(2, NGRAMS[-1] + 1):
            if len(a) < n:
                break
            acc = (acc[:-1] * np.uint32(0x01000193)) ^ (a[n - 1 :] * np.uint32(0x85EBCA77) + np.uint32(n))
            if n in NGRAMS:
                x = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _distinct(self, f: np.ndarray) -> np.ndarray:
        at = np.arange(len(f), dtype=np.int32)
        self.mark[f] = at
        return f[self.mark[f] == at]

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = f" {text.lower()} "
        step = SLICE - NGRAMS[-1] + 1
        parts = [self._distinct(self._hashed(text[i : i + SLICE])) for i in range(0, max(1, len(text) - NGRAMS[-1] + 1), step)]
        return np.sort(parts[0] if len(parts) == 1 else self._distinct(np.concatenate(parts))).astype(np.int32)


def _values(model_ratio: np.ndarray, f: np.ndarray) -> np.ndarray:
    v = model_ratio[f]
    return v / max(float(np.sqrt(v @ v)), 1e-9) ** 0.5 if len(v) else v


def _packed(f: np.ndarray) -> bytes:
    """Sorted buckets as compressed gaps: about a byte each."""
    return zlib.compress(np.diff(f, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<i4"))


def fit(features: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Ratios from document counts, then mini-batch Adam on the logistic loss; the classes weigh alike."""
    toxic = labels == 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, fitted=False)
    counts = np.ones((2, BUCKETS))
    for f, y in zip(features, toxic, strict=True):
        counts[int(y), _unpacked(f)] += 1
    ratio = (np.log(counts[1] / (n1 + 2)) - np.log(counts[0] / (n0 + 2))).astype(np.float32)
    class_weight = np.where(toxic, n0 / n1, 1.0) / 2
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(features))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            own = [_unpacked(features[i]) for i in rows]
            at = np.concatenate(own)
            x = np.concatenate([_values(ratio, f) for f in own])
            owner = np.repeat(np.arange(len(rows)), [len(f) for f in own])
            z = np.bincount(owner, x * w[at], len(rows)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic[rows]) * class_weight[rows] / len(rows)
            g = np.bincount(at, x * error[owner], BUCKETS + 1) + DECAY * w
            g[-1] = error.sum()
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(ratio, w[:-1].astype(np.float32), float(w[-1]))


def score(model: Model, features: Features, text: str | None) -> float:
    if not model.fitted:
        return 0.0
    f = features(text)
    z = float(_values(model.ratio, f) @ model.weight[f]) + model.bias if len(f) else model.bias
    return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def _featurize(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = Features()
    for pdf in source:
        yield pd.DataFrame({"place": pdf["place"], "toxic": pdf["toxic"], "f": [_packed(features(t)) for t in pdf["text"]]})


def _fitted(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows. Packed features stay packed but for one batch at a time."""
    place, toxic, features = [], [], []
    for pdf in source:
        place += pdf["place"].tolist()
        toxic += pdf["toxic"].tolist()
        features += pdf["f"].tolist()
    order = np.argsort(np.array(place, np.int64), kind="stable")
    model = fit([features[i] for i in order], np.array(toxic, np.int64)[order])
    yield pd.DataFrame({"ratio": [model.ratio.tobytes()], "weight": [model.weight.tobytes()], "bias": [model.bias], "fitted": [model.fitted]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, usable=None) -> Model:
    """labels: id and toxic. usable: a condition on the id that labelled rows for the fit meet."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    chosen = known.groupBy(id_col).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    # fit_rows bounds what is broadcast and, as each id gives one row, what the fit reads.
    spark = docs.sparkSession
    listed = spark.createDataFrame(chosen.toPandas(), chosen.schema)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(listed), id_col)
    rows = rows.groupBy(id_col).agg(F.min(F.struct(F.xxhash64(id_col, "text").alias("place"), "toxic", "text")).alias("r")).select("r.*")
    # The at most fit_rows packed rows meet in one task; the driver gets the model alone.
    fitted = rows.mapInPandas(_featurize, "place long, toxic int, f binary").repartition(1).mapInPandas(_fitted, "ratio binary, weight binary, bias double, fitted boolean").first()
    if fitted is None:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(fitted.ratio, np.float32), np.frombuffer(fitted.weight, np.float32), fitted.bias, fitted.fitted)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a score in (0, 1), in a column that docs doesn't have yet; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in source:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            values = pa.array([score(shared.value, features, t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, docs.withColumn(name, F.lit(0.0)).schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, held_out, score, predicted for each row of docs; labels of held-out rows are never read."""
    model = train(docs, labels, id_col, text_col, fit_rows, ~held_out(id_col))
    (name,) = free(docs.select(id_col, text_col), "score")
    scored = with_score(docs.select(id_col, text_col), model, text_col, name)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of docs that score under 0.5, all columns."""
    model = train(docs, labels, id_col, text_col, fit_rows, ~held_out(id_col))
    (name,) = free(docs, "score")
    return with_score(docs, model, text_col, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
