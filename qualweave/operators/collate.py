"""Dense batches of reads of similar length, one row a batch.

Reads are taken in blocks of neighbouring ids; within a block those whose lengths share a
bucket are cut into batches. Bucket bounds rise by a factor of 1 + slack, so a batch is
padded by at most slack of its symbols. No window spans more than a block.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualweave.constants import PAD_TARGET, Q_BOS, R_BOS
from qualweave.errors import SequenceError

BATCH_READS = 64
BLOCK_READS = 4096
SLACK = 0.25
#: What padding holds.
FILLS = {"q_hat": 0, "prev_q": Q_BOS, "prev_r": R_BOS, "target": PAD_TARGET}


def bucket_bounds(slack: float = SLACK, longest: int = 1 << 40) -> list[int]:
    """Rising lengths, each at most 1 + slack times the one before plus one."""
    if slack < 0:
        raise SequenceError("slack must not be negative")
    out = [1]
    while out[-1] < longest and len(out) < 10_000:
        out.append(max(out[-1] + 1, int((out[-1] + 1) * (1 + slack))))
    return out


def batches(reads: DataFrame, batch_reads: int = BATCH_READS, slack: float = SLACK, block_reads: int = BLOCK_READS) -> DataFrame:
    """file, read_id, length, block, bucket, part: the batch of each read that isn't empty."""
    if batch_reads <= 0 or block_reads <= 0:
        raise SequenceError("batches and blocks must have a read at least")
    bounds = F.array(*[F.lit(b).cast("long") for b in bucket_bounds(slack)])
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("length")))
    dealt = reads.where("length > 0").select("file", "read_id", "length", F.floor(F.col("read_id") / block_reads).alias("block"), bucket.alias("bucket"))
    place = F.row_number().over(Window.partitionBy("file", "block", "bucket").orderBy("read_id")) - 1
    return dealt.withColumn("part", F.floor(place / batch_reads).cast("int"))


def padded(df: DataFrame, reads: DataFrame, fills: Mapping[str, int] = FILLS, batch_reads: int = BATCH_READS, slack: float = SLACK, block_reads: int = BLOCK_READS) -> DataFrame:
    """file, block, bucket, part, width, read_ids, lengths, valid, and for each column of fills a dense array, reads by width, row by row.

    df: positions with the columns of fills. A column may hold arrays of one length; its fill is then repeated in them.
    """
    kinds = dict(df.dtypes)
    of_read = df.groupBy("file", "read_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fills))).alias("seq"))
    placed = of_read.join(batches(reads, batch_reads, slack, block_reads).hint("merge"), ["file", "read_id"])
    rows = placed.groupBy("file", "block", "bucket", "part").agg(F.sort_array(F.collect_list(F.struct("read_id", "length", "seq"))).alias("reads"), F.max("length").alias("width"))

    def dense(name: str) -> Column:
        fill = F.lit(fills[name])
        if kinds[name].startswith("array"):
            element = kinds[name][len("array<") : -1]
            fill = F.array_repeat(fill.cast(element), F.size(F.get(F.col("reads")[0]["seq"], F.lit(0))[name]))
        else:
            fill = fill.cast(kinds[name])
        line = lambda r: F.concat(r["seq"][name], F.array_repeat(fill, F.col("width") - F.size(r["seq"])))
        return F.flatten(F.transform("reads", line)).alias(name)

    valid = F.flatten(F.transform("reads", lambda r: F.concat(F.array_repeat(F.lit(True), F.size(r["seq"])), F.array_repeat(F.lit(False), F.col("width") - F.size(r["seq"])))))
    return rows.select("file", "block", "bucket", "part", "width", F.col("reads.read_id").alias("read_ids"), F.col("reads.length").alias("lengths"), valid.alias("valid"), *[dense(c) for c in fills])
