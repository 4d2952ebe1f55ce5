"""Splits by read, ranges, limits and batches, all as predicates on read_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualweave.constants import TRAIN_FRACTION
from qualweave.errors import SequenceError
from qualweave.sources import manifest


#: At most so many rows are broadcast by counted(); one row a file or a predictor vector.
BROADCAST_ROWS = 20_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows, which are counted first; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def split_count(n: int, fraction: float = TRAIN_FRACTION) -> int:
    """Train reads of n."""
    return max(1, min(n - 1, int(n * fraction)))


def train_reads(reads: DataFrame, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """file, first, n, train_n. The product is of doubles and truncated."""
    n = F.count("*")
    train = F.greatest(F.lit(1), F.least(n - 1, (n * F.lit(float(fraction))).cast("long")))
    return reads.groupBy("file").agg(F.min("read_id").alias("first_id"), n.alias("n"), train.cast("long").alias("train_n"))


def bounds(reads: DataFrame, split: str, fraction: float = TRAIN_FRACTION, max_reads: int | None = None) -> DataFrame:
    """file, start, stop: the half-open range of read ids of a split; max_reads counts empty reads too."""
    if split not in ("train", "test", "all"):
        raise SequenceError(f"unknown split: {split}")
    first, train, n = F.col("first_id"), F.col("train_n"), F.col("n")
    start = first + train if split == "test" else first
    stop = first + train if split == "train" else first + n
    stop = F.least(stop, start + max_reads) if max_reads is not None else stop
    return train_reads(reads, fraction).select("file", start.alias("start"), stop.alias("stop"))


#: Ranges of so many files are written into a query as literals; those of more are joined.
LITERAL_FILES = 200


def within(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of df whose read is in its file's range. ranges: one row a file.

    The bounds are fetched, so that they are literals which scans and windows by read can use.
    """
    few = ranges.limit(LITERAL_FILES + 1).collect()
    if not few:
        return df.where(F.lit(False))
    if len(few) > LITERAL_FILES:
        ends = ranges.agg(F.min("start").alias("start"), F.max("stop").alias("stop")).first()
        some = df.where((F.col("read_id") >= ends.start) & (F.col("read_id") < ends.stop))
        ranges = ranges.select("file", "start", "stop")
        return some.join(counted(ranges), "file").where((F.col("read_id") >= F.col("start")) & (F.col("read_id") < F.col("stop"))).drop("start", "stop")
    chosen = F.lit(False)
    for r in few:
        chosen = chosen | ((F.col("file") == r.file) & (F.col("read_id") >= r.start) & (F.col("read_id") < r.stop))
    return df.where(chosen & (F.col("read_id") >= min(r.start for r in few)) & (F.col("read_id") < max(r.stop for r in few)))


def head(reads: DataFrame, n: int) -> DataFrame:
    """file, start, stop, rows: the reads that hold the first n symbols in order of file and read, and how many symbols each file gives.

    Running counts of reads decide, before a position is read or a feature made.
    """
    placed = manifest.offsets(reads)
    sizes = placed.groupBy("file").agg(F.max("row_stop").alias("size"))
    base = sizes.select("file", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "size")
    chosen = placed.join(counted(base), "file").where((F.col("base") + F.col("row_start") < n) & (F.col("row_stop") > F.col("row_start")))
    return chosen.groupBy("file").agg(F.min("read_id").alias("start"), (F.max("read_id") + 1).alias("stop"), F.max(F.least(F.col("size"), n - F.col("base"))).cast("long").alias("rows"))


def read_range(positions: DataFrame, starts: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions of reads start to stop - 1 with row indexes counted from the range's first row. starts: offsets().

    A range that is empty or goes past the last read of a file is an error.
    """
    if stop <= start:
        raise SequenceError(f"empty read range: {start} to {stop}")
    chosen = (F.col("read_id") >= start) & (F.col("read_id") < stop)
    some = starts.where(chosen)
    short = some.groupBy("file").agg(F.count("*").alias("n"), F.min("row_start").alias("base")).collect()
    if not short or any(r.n < stop - start for r in short):
        raise SequenceError(f"read range {start} to {stop} goes beyond the reads of a file")
    base = positions.sparkSession.createDataFrame([(r.file, r.base) for r in short], "file string, base long")
    return positions.where(chosen).join(some.join(F.broadcast(base), "file"), ["file", "read_id"]).withColumn("row_idx", F.col("row_start") - F.col("base") + F.col("pos")).drop("row_start", "row_stop", "base")


def with_length(positions: DataFrame, reads: DataFrame) -> DataFrame:
    """positions and their read's length.

    Both sides are dealt by read. A broadcast would take the exploded side for small, by
    its file's size, and evaluate the length's expression again for each position.
    """
    return positions.join(reads.hint("merge"), ["file", "read_id"])


def nonempty(reads: DataFrame) -> DataFrame:
    return reads.where("length > 0")


def batches(reads: DataFrame, ranges: DataFrame, batch_reads: int) -> DataFrame:
    """file, batch_id and the shape of each batch; batches without symbols are left out but keep their number."""
    placed = reads.join(counted(ranges), "file").where((F.col("read_id") >= F.col("start")) & (F.col("read_id") < F.col("stop")))
    batch = F.floor((F.col("read_id") - F.col("start")) / batch_reads).cast("long")
    full = F.col("length") > 0
    out = placed.groupBy("file", batch.alias("batch_id")).agg(
        F.min("read_id").alias("first_read"), F.count("*").alias("reads"), F.sum(full.cast("long")).alias("kept_reads"), F.sum("length").cast("long").alias("symbols"), F.max("length").alias("width")
    )
    return out.where("kept_reads > 0").withColumn("padded", F.col("kept_reads") * F.col("width") - F.col("symbols"))


def sampling_weights(reads: DataFrame, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """file, train_n, weight: files are drawn in proportion to their train reads."""
    everything = Window.partitionBy(F.lit(1))
    return train_reads(reads, fraction).select("file", "train_n", (F.col("train_n") / F.sum("train_n").over(everything)).alias("weight"))
