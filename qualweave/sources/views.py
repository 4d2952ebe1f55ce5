"""Sequences as two DataFrames, and views of the test tables as such sequences.

reads:      file, read_id, length            (one row per read, empty ones too)
positions:  file, read_id, pos, observed, pred_key
predictors: file, pred_key, freqs            (counts of the 95 ids, float)

Positions may hold their own counts (freqs) instead of a pred_key, as those of HDF5 files do.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualweave.constants import ALPHABET, TRAIN_FRACTION
from qualweave.operators.split import counted, train_reads
from qualweave.session import table
from qualweave.sources import files, manifest


@dataclass
class Sequences:
    reads: DataFrame
    positions: DataFrame
    #: file, idx, row: where reads begin in rows that were given flat, if they were.
    boundaries: DataFrame | None = None

    @property
    def own_counts(self) -> bool:
        return "freqs" in self.positions.columns


def stored(spark: SparkSession, paths: Iterable[str | Path], reads_a_task: int = 10_000) -> Sequences:
    """The reads of HDF5 files (folders give their own files), in which each position has its own counts.

    Files are checked when a scan is planned. Ranges of reads reach the scan where
    spark.sql.python.filterPushdown.enabled is true; it is set here, as it is off by default.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(files.Hdf5Source)
    source = spark.read.format("quality_h5").option("path", ",".join(map(str, files.discover(paths)))).option("reads_a_task", reads_a_task)
    return Sequences(source.option("table", "reads").load(), source.option("table", "positions").load().drop("row_idx"))


def flat(rows: DataFrame, boundaries: DataFrame) -> Sequences:
    """Reads of flat rows (file, row, observed, pred_key) that boundaries (file, idx, row) part: read idx has the rows from its boundary up to the next.

    Boundaries are checked before anything is derived from them. Rows find their read by an
    equi-join on their place, so a long file is dealt out like many short ones.
    """
    manifest.require_boundaries(boundaries, rows.groupBy("file").agg(F.count("*").alias("rows")))
    reads = manifest.lengths(boundaries)
    starts = reads.where("length > 0").join(boundaries.select("file", F.col("idx").alias("read_id"), F.col("row").alias("start")), ["file", "read_id"])
    placed = starts.select("file", "read_id", "start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos")).withColumn("row", F.col("start") + F.col("pos"))
    positions = rows.join(placed, ["file", "row"]).select("file", "read_id", "pos", "observed", "pred_key")
    return Sequences(reads, positions, boundaries)


def orders(spark: SparkSession, sf_dir: str) -> Sequences:
    """Short reads, some empty: the quantities of an order's lines."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders")
    # Windows are dealt by read_id itself, so that a condition on it passes below them to the scan.
    key = Window.partitionBy("read_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    known = line.join(order.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").withColumnRenamed("l_orderkey", "read_id")
    positions = known.select(
        F.lit("orders").alias("file"),
        "read_id",
        (F.row_number().over(key) - 1).alias("pos"),
        F.col("l_quantity").cast("int").alias("observed"),
        F.col("l_linenumber").cast("string").alias("pred_key"),
    )
    lengths = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("length"))
    reads = order.join(lengths, "o_orderkey", "left").select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("read_id"), F.coalesce("length", F.lit(0)).alias("length"))
    return Sequences(reads, positions)


def events(spark: SparkSession, sf_dir: str) -> Sequences:
    """Medium reads: the clipped values of a user's events in time order."""
    event = table(spark, sf_dir, "events").withColumnRenamed("user_id", "read_id")
    positions = event.select(
        F.lit("events").alias("file"),
        "read_id",
        (F.row_number().over(Window.partitionBy("read_id").orderBy("ts", "event_id")) - 1).alias("pos"),
        F.floor(F.least("value", F.lit(94.0))).cast("int").alias("observed"),
        F.col("event_type").alias("pred_key"),
    )
    reads = event.groupBy("read_id").agg(F.count("*").cast("int").alias("length")).select(F.lit("events").alias("file"), "read_id", "length")
    return Sequences(reads, positions)


def documents(spark: SparkSession, sf_dir: str) -> Sequences:
    """Long reads: the printable ASCII characters of a document."""
    kept = F.regexp_replace("text", r"[^\x21-\x7E]", "")
    document = table(spark, sf_dir, "documents").select("doc_id", "lang", kept.alias("t"))
    positions = (
        document.where("t <> ''")
        .select("doc_id", "lang", F.posexplode(F.split("t", "")).alias("pos", "c"))
        .where("c <> ''")
        .select(F.lit("documents").alias("file"), F.col("doc_id").alias("read_id"), "pos", (F.ascii("c") - 33).alias("observed"), F.col("lang").alias("pred_key"))
    )
    reads = document.select(F.lit("documents").alias("file"), F.col("doc_id").alias("read_id"), F.char_length("t").alias("length"))
    return Sequences(reads, positions)


VIEWS = {"orders": orders, "events": events, "documents": documents}


def predictors(view: Sequences, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Counts of ids among train reads by (file, pred_key); a key that only test reads have gets zeros."""
    split = train_reads(view.reads, fraction).select("file", "train_n")
    first = view.reads.groupBy("file").agg(F.min("read_id").alias("first"))
    placed = view.positions.join(counted(split.join(first, "file")), "file")
    train = F.col("read_id") < F.col("first") + F.col("train_n")
    counts = placed.groupBy("file", "pred_key", "observed").agg(F.sum(train.cast("long")).alias("n"))
    by_id = F.map_from_entries(F.collect_list(F.struct("observed", "n")))
    freqs = F.transform(F.sequence(F.lit(0), F.lit(ALPHABET - 1)), lambda q: F.coalesce(F.element_at("m", q), F.lit(0).cast("long")).cast("float"))
    return counts.groupBy("file", "pred_key").agg(by_id.alias("m")).select("file", "pred_key", freqs.alias("freqs"))
