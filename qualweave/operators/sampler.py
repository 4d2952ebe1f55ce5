"""A seeded plan of contiguous blocks of train reads, with replacement.

Numbers are counter-based: a hash of seed, step, try and purpose. Any engine can compute
them, any step on its own, and a step that is drawn again changes no other step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualweave.constants import SEED, TRAIN_FRACTION
from qualweave.operators.split import counted, train_reads
from qualweave.session import cut
from qualweave.sources import manifest

TRIES = 100
#: Tries made for all steps at first; only steps that they leave empty make the others.
FIRST_TRIES = 4


def number(seed: int, purpose: str) -> Column:
    """A uniform integer of 60 bits for columns step and try: leading hex digits of an MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col("step").cast("string"), F.col("try").cast("string"), F.lit(purpose))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _drawn(steps: DataFrame, files: DataFrame, tries: tuple[int, int], batch_reads: int, seed: int) -> DataFrame:
    """step, try, file, start, stop: a file in proportion to its train reads, then a block of it."""
    numbered = steps.select("step", F.explode(F.sequence(F.lit(tries[0]), F.lit(tries[1] - 1))).alias("try"))
    drawn = numbered.withColumns({"at": number(seed, "file"), "within": number(seed, "start")})
    # One row a file: the draw falls into the file's part of all train reads.
    joined = drawn.join(files, (F.col("at") % F.col("total") >= F.col("before")) & (F.col("at") % F.col("total") < F.col("before") + F.col("train_n")))
    size = F.least(F.lit(batch_reads).cast("long"), F.col("train_n"))
    start = F.col("first_id") + F.col("within") % (F.col("train_n") - size + 1)
    return joined.select("step", "try", "file", start.alias("start"), (start + size).alias("stop"))


def plan(spark: SparkSession, reads: DataFrame, steps: int, batch_reads: int, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> DataFrame:
    """step, file, start, stop: of the blocks that a step draws, the first with a symbol; none in TRIES tries is an error where the row is read.

    A block has symbols if the running count of symbols rises over it: two equi-joins with
    the reads' offsets, whatever the blocks' size.
    """
    by_name = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    files = train_reads(reads, fraction).withColumns({"before": F.coalesce(F.sum("train_n").over(by_name), F.lit(0)), "total": F.sum("train_n").over(everything)})
    files = F.broadcast(cut(files))  # one row a file
    placed = cut(manifest.offsets(reads))
    begin = placed.select("file", F.col("read_id").alias("start"), F.col("row_start").alias("low"))
    end = placed.select("file", (F.col("read_id") + 1).alias("stop"), F.col("row_stop").alias("high"))
    left, found = spark.range(steps).select(F.col("id").alias("step")), None
    for tries in ((0, FIRST_TRIES), (FIRST_TRIES, TRIES)):
        full = _drawn(left, files, tries, batch_reads, seed).join(begin, ["file", "start"]).join(end, ["file", "stop"]).where("high > low")
        first = cut(full.groupBy("step").agg(F.min(F.struct("try", "file", "start", "stop")).alias("b")).select("step", "b.file", "b.start", "b.stop"))
        found = first if found is None else found.unionByName(first)
        left = cut(left.join(counted(first.select("step")), "step", "left_anti"))
        if left.isEmpty():
            return found
    failed = F.raise_error(F.lit(f"failed to sample a batch with non-empty reads after {TRIES} attempts"))
    return found.unionByName(left.select("step", failed.cast("string").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")))


def blocks_of(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Reads of each step's block; an equi-join on (file, read_id)."""
    ids = blocks.select("step", "file", F.explode(F.sequence("start", F.col("stop") - 1)).alias("read_id"))
    return reads.join(ids, ["file", "read_id"])
