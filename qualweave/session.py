"""Session helpers shared by every query."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed.

    A cluster ships it with --py-files or an image; this covers a checkout that
    driver and workers share, as in tests.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts need less
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Workers live on between stages: large arrays go back to the system as soon as they are freed.
    for name, value in (("MALLOC_MMAP_THRESHOLD_", 1 << 20), ("MALLOC_TRIM_THRESHOLD_", 8 << 20), ("MALLOC_ARENA_MAX", 2)):
        env.setdefault(name, str(value))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(where or "/tmp/checkpoints/qualweave")
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage; for jobs that end in cut()."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, for loops.

    Unlike a checkpoint, a table has the size of its files; estimated sizes of joins would
    grow by multiplication from round to round.
    """
    where = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
