"""Manifests of files, and checks of their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualweave.constants import ALPHABET, MAX_ID
from qualweave.errors import SequenceError


def manifest(reads: DataFrame) -> DataFrame:
    """file, row_count, read_count, empty_reads and the length statistics of reads that aren't empty."""
    length = F.when(F.col("length") > 0, F.col("length"))
    return reads.groupBy("file").agg(
        F.sum("length").cast("long").alias("row_count"),
        F.count("*").alias("read_count"),
        F.sum((F.col("length") == 0).cast("long")).alias("empty_reads"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(length).alias("mean_length"),
    )


#: Reads summed together before blocks are; no window spans more rows than this or the number of blocks.
BLOCK = 1 << 16


def offsets(reads: DataFrame) -> DataFrame:
    """file, read_id, row_start, row_stop: boundaries of reads by running sums, within blocks and over blocks."""
    block = F.floor(F.col("read_id") / BLOCK)
    within = Window.partitionBy("file", "block").orderBy("read_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = reads.withColumn("block", block)
    sums = placed.groupBy("file", "block").agg(F.sum("length").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    stop = F.sum("length").over(within)
    return placed.withColumn("stop", stop).join(sums, ["file", "block"]).select("file", "read_id", (F.col("base") + F.col("stop") - F.col("length")).cast("long").alias("row_start"), (F.col("base") + F.col("stop")).cast("long").alias("row_stop"))


def lengths(boundaries: DataFrame) -> DataFrame:
    """file, read_id, length from boundaries (file, idx, row): read idx ends where the next one starts.

    A join by place instead of a window: no file's boundaries meet in one task.
    """
    stops = boundaries.select("file", (F.col("idx") - 1).alias("idx"), F.col("row").alias("stop"))
    return boundaries.join(stops, ["file", "idx"]).select("file", F.col("idx").alias("read_id"), (F.col("stop") - F.col("row")).cast("int").alias("length"))


#: Rules of given boundaries, as their faults are named.
BOUNDARY_CHECKS = {
    "boundary_places": "places don't count from 0 without a gap",
    "too_few_boundaries": "fewer than two boundaries",
    "first_boundary": "the first isn't 0",
    "falling_boundaries": "they fall",
    "last_boundary": "the last isn't the number of rows",
}


def boundary_faults(boundaries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each file with a column for each of BOUNDARY_CHECKS: how often it is broken.

    boundaries: file, idx, row. rows: file, rows. Falls are found within blocks of neighbours,
    and from the last boundary of a block to the first of the next: blocks carry their edges,
    so no file's boundaries meet in one task, and they aren't joined with themselves.
    """
    within = Window.partitionBy("file", "block").orderBy("idx", "row")
    inner = boundaries.withColumn("block", F.floor(F.col("idx") / BLOCK)).withColumn("fell", (F.lag("row").over(within) > F.col("row")).cast("long"))
    edges = inner.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.count_distinct("idx").alias("places"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.sum("fell").alias("falls"),
        F.min(F.struct("idx", "row"))["row"].alias("head"), F.max(F.struct("idx", "row"))["row"].alias("tail"),
    )
    carried = F.lag("tail").over(Window.partitionBy("file").orderBy("block"))
    files = edges.withColumn("falls", F.coalesce("falls", F.lit(0)) + F.coalesce((carried > F.col("head")).cast("long"), F.lit(0))).groupBy("file").agg(
        F.sum("n").alias("n"), F.sum("places").alias("places"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("falls").alias("falls"),
        F.min_by("head", "block").alias("first"), F.max_by("tail", "block").alias("last"),
    )
    broken = {
        "boundary_places": F.col("n").isNotNull() & ((F.col("low") != 0) | (F.col("n") != F.col("high") + 1) | (F.col("n") != F.col("places"))),
        "too_few_boundaries": F.coalesce("n", F.lit(0)) < 2,
        "first_boundary": ~F.col("first").eqNullSafe(F.lit(0)),
        "last_boundary": ~F.col("last").eqNullSafe(F.col("rows")),
    }
    falls = F.coalesce("falls", F.lit(0)).cast("long").alias("falling_boundaries")
    return files.join(rows, "file", "full").select("file", *[falls if c == "falling_boundaries" else broken[c].cast("long").alias(c) for c in BOUNDARY_CHECKS])


def require_boundaries(boundaries: DataFrame, rows: DataFrame) -> None:
    """Raises SequenceError unless each file's boundaries (file, idx, row) are two at least, start at 0, never fall and end at its rows (file, rows)."""
    faulty = boundary_faults(boundaries, rows).where(" or ".join(f"{c} > 0" for c in BOUNDARY_CHECKS))
    # Only broken files come to the driver, and of those as many as a message can name.
    broken = [f"{r.file}: {what}" for r in faulty.orderBy("file").limit(NAMED_FILES).collect() for c, what in BOUNDARY_CHECKS.items() if r[c]]
    if broken:
        raise SequenceError("; ".join(broken))


#: Files that an error names at most.
NAMED_FILES = 20


def _stacked(totals: DataFrame, checks: list[str]) -> DataFrame:
    """check, violations from one row with a column for each check."""
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in checks])
    return totals.select(F.inline(rows))


def violations(reads: DataFrame, positions: DataFrame, freqs: DataFrame | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """check, violations: how often each rule is broken; all rules are listed.

    Positions and reads are each scanned once: counts of a read's positions are joined with
    its length, summed by file, and then over files. boundaries: file, idx, row.
    """
    bad = ~F.coalesce(F.col("observed").between(0, MAX_ID), F.lit(False))
    stored = positions.groupBy("file", "read_id").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.sum(bad.cast("long")).alias("bad"))
    both = reads.select("file", "read_id", "length").join(stored, ["file", "read_id"], "full")
    count = lambda broken: F.sum(F.coalesce(broken, F.lit(False)).cast("long"))
    files = both.groupBy("file").agg(
        F.sum("bad").alias("observed_range"),
        count(F.col("length") < 0).alias("negative_length"),
        count(F.coalesce("length", F.lit(-1)) != F.coalesce("n", F.lit(0))).alias("row_alignment"),
        count(F.col("n").isNotNull() & (F.col("top") != F.col("n") - 1)).alias("dense_positions"),
        F.max("length").alias("longest"),
    )
    checks = ["observed_range", "negative_length", "row_alignment", "dense_positions"]
    out = _stacked(files.agg(*[F.sum(c).alias(c) for c in checks], count(F.col("longest") <= 0).alias("all_reads_empty")), [*checks, "all_reads_empty"])
    if freqs is not None:
        out = out.unionByName(_stacked(freqs.agg(count(F.size("freqs") != ALPHABET).alias("alphabet_width")), ["alphabet_width"]))
    if boundaries is not None:
        rows = positions.groupBy("file").agg(F.count("*").alias("rows"))
        faults = boundary_faults(boundaries, rows).agg(*[F.sum(c).alias(c) for c in BOUNDARY_CHECKS])
        out = out.unionByName(_stacked(faults, list(BOUNDARY_CHECKS)))
    return out


def require_valid(reads: DataFrame, positions: DataFrame, freqs: DataFrame | None = None, boundaries: DataFrame | None = None) -> None:
    """Raises SequenceError naming each broken rule."""
    for name, df, needed in (("reads", reads, {"file", "read_id", "length"}), ("positions", positions, {"file", "read_id", "pos", "observed"})):
        if missing := needed - set(df.columns):
            raise SequenceError(f"{name} lacks {', '.join(sorted(missing))}")
    broken = [f"{r.check}: {r.violations}" for r in violations(reads, positions, freqs, boundaries).where("violations > 0").collect()]
    if broken:
        raise SequenceError("; ".join(broken))
