"""Command lines: train and predict over HDF5 files, or over a sequence view of Parquet tables."""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualweave import progress
from qualweave.constants import CONTEXT, Q_KS, R_KS, SEED, STRIDE, TRAIN_FRACTION, VOCAB
from qualweave.functions.predictor import described
from qualweave.errors import SequenceError
from qualweave.functions.symbols import INVARIANTS, parse_ks, six
from qualweave.operators import metrics, sinks, split
from qualweave.plans import infer, network, packing, training
from qualweave.session import ensure_workers
from qualweave.sources import manifest
from qualweave.sources.views import VIEWS, Sequences, predictors, stored

RUNS = "runs/transformer_residual_qrmer"
#: The folder of HDF5 files that a run without inputs reads.
INPUT = "h5"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="qualweave")
    commands = top.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--data", help="folder of Parquet tables, read instead of HDF5 files")
    shared.add_argument("--view", choices=sorted(VIEWS), default="events")
    shared.add_argument("--no-progress", action="store_true")
    shared.add_argument("--device", choices=("auto", "cpu"), default="auto", help="tasks compute with NumPy; both mean the CPU")
    shared.add_argument("--train-fraction", type=float, default=TRAIN_FRACTION)
    inputs = {"nargs": "*", "default": [INPUT], "help": "HDF5 files, or folders of them"}
    t = commands.add_parser("train", parents=[shared])
    t.add_argument("inputs", **inputs)
    t.add_argument("--output-dir", default=RUNS)
    for flag, value in (("epochs", 5), ("steps-per-epoch", 1000), ("batch-reads", 64), ("eval-batch-reads", infer.BATCH_READS), ("eval-max-reads-per-file", 5000), ("q-hat-embed-dim", 16), ("prev-q-embed-dim", 16), ("prev-r-embed-dim", 32), ("qmer-vocab-size", VOCAB), ("rmer-vocab-size", VOCAB), ("qmer-embed-dim", 8), ("rmer-embed-dim", 8), ("mer-stride", STRIDE), ("d-model", 256), ("num-heads", 4), ("num-layers", 2), ("feedforward-dim", 512), ("context-length", CONTEXT), ("seed", SEED)):
        t.add_argument(f"--{flag}", type=int, default=value)
    for flag, value in (("lr", 1e-3), ("weight-decay", 1e-5), ("grad-clip", 1.0)):
        t.add_argument(f"--{flag}", type=float, default=value)
    t.add_argument("--qmer-ks", type=parse_ks, default=Q_KS)
    t.add_argument("--rmer-ks", type=parse_ks, default=R_KS)
    t.add_argument("--save-every-epoch", action="store_true")
    p = commands.add_parser("predict", parents=[shared])
    p.add_argument("checkpoint")
    p.add_argument("inputs", **inputs)
    p.add_argument("--batch-reads", type=int, default=infer.BATCH_READS)
    p.add_argument("--split", choices=("test", "train", "all"), default="test")
    p.add_argument("--max-reads-per-file", type=int)
    p.add_argument("--output-csv", default=f"{RUNS}/predict_metrics.csv")
    p.add_argument("--sample-predictions")
    p.add_argument("--sample-reads", type=int, default=5)
    p.add_argument("--quality-prob-log")
    p.add_argument("--quality-prob-log-rows", type=int, default=1000)
    p.add_argument("--no-quality-prob-log", action="store_true")
    return top


def _view(spark: SparkSession, a: argparse.Namespace) -> Sequences:
    return VIEWS[a.view](spark, a.data) if a.data else stored(spark, a.inputs)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.eval_max_reads_per_file < 0:
        raise SystemExit("--eval-max-reads-per-file must be 0 (all) or more")
    config = network.Config(a.q_hat_embed_dim, a.prev_q_embed_dim, a.prev_r_embed_dim, a.qmer_ks, a.rmer_ks, a.qmer_vocab_size, a.rmer_vocab_size, a.qmer_embed_dim, a.rmer_embed_dim, a.d_model, a.num_heads, a.num_layers, a.feedforward_dim, a.context_length, a.mer_stride)
    view = _view(spark, a)
    if not view.own_counts:  # HDF5 files are checked as they are planned, and their ids where they are read.
        manifest.require_valid(view.reads, view.positions, boundaries=view.boundaries)
    found = [r.asDict() for r in manifest.manifest(view.reads).orderBy("file").toLocalIterator()]
    about = {"model_type": "transformer_residual", "uses_qr_mer": bool(a.qmer_ks or a.rmer_ks), "input_files": [r["file"] for r in found], "files": found}
    sinks.save_json(vars(a) | about, Path(a.output_dir) / "config.json")
    path, whole = Path(a.output_dir) / "train_log.csv", {"epoch", "val_total_symbols", "val_zero_true_freq"}
    path.write_text("", encoding="utf-8")

    def report(row: dict) -> None:
        """Each epoch is written as it ends, so that a run that breaks off keeps its log."""
        values = ",".join(str(v) if k in whole else six(v) for k, v in row.items())
        with path.open("a", encoding="utf-8", newline="") as log:
            log.write((",".join(row) + "\r\n" if row["epoch"] == 1 else "") + f"{values}\r\n")
        gain = "no baseline" if row["val_relative_improvement"] is None else f"improvement {row['val_relative_improvement']:.4%}"
        print(f"epoch {row['epoch']}: train {six(row['train_bits_per_quality'])} bits, validation {six(row['val_model_avg_bits_per_quality'])} bits, {gain}", flush=True)

    with progress.shown(spark, "train", not a.no_progress):
        training.train(view, a.output_dir, config, a.epochs, a.steps_per_epoch, a.batch_reads, a.eval_max_reads_per_file or None, a.train_fraction, a.lr, a.weight_decay, a.grad_clip, a.seed, a.save_every_epoch, report, a.eval_batch_reads)
    print(f"wrote {path}")


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.max_reads_per_file is not None and a.max_reads_per_file <= 0:
        raise SystemExit("--max-reads-per-file must be positive")
    view = _view(spark, a)
    config, parameters, _ = network.load(a.checkpoint)
    vectors = None if view.own_counts else described(predictors(view, a.train_fraction))

    def scored(ranges: DataFrame) -> DataFrame:
        return infer.score(packing.packed(view, vectors, config, ranges), config, parameters, a.batch_reads)

    table = metrics.compression(scored(split.bounds(view.reads, a.split, a.train_fraction, a.max_reads_per_file)))
    with progress.shown(spark, "predict", not a.no_progress):
        rows = sorted(metrics.require_symbols(table), key=lambda r: r.file)
    for r in rows:
        print(f"{r.file}: {r.total_symbols} symbols, {six(r.model_avg_bits_per_quality)} bits, baseline {six(r.h5_baseline_avg_bits_per_quality)} bits")
    kept = spark.createDataFrame(rows, table.schema).orderBy("file")
    sinks.write_csv(kept.select(*[F.col(c) if kind in ("string", "bigint") else sinks.decimals(F.col(c)).alias(c) for c, kind in table.dtypes]), a.output_csv)
    print(f"wrote {a.output_csv}")
    if a.sample_predictions:
        first = view.reads.agg(F.min("file")).first()[0]
        ranges = split.bounds(view.reads.where(F.col("file") == first), a.split, a.train_fraction, a.sample_reads)
        sinks.write_csv(sinks.sample_rows(scored(ranges), split.within(view.reads, ranges)).orderBy("read_in_sample", "position_in_read"), a.sample_predictions)
        print(f"wrote {a.sample_predictions}")
    if a.quality_prob_log and not a.no_quality_prob_log:
        part = split.within(view.reads, split.bounds(view.reads, a.split, a.train_fraction))
        rows = sinks.first_rows(scored(split.head(part, a.quality_prob_log_rows)), a.quality_prob_log_rows, ["file", "read_id", "pos"])
        sinks.write_text(sinks.compact_lines(rows).orderBy("file", "read_id", "pos"), a.quality_prob_log)
        print(f"wrote {a.quality_prob_log}")


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "train" and not 0 < a.train_fraction < 1:
        raise SystemExit("--train-fraction must be in (0, 1)")
    if min(a.batch_reads, getattr(a, "eval_batch_reads", 1)) < 1:
        raise SystemExit("batches of reads must be positive")
    spark = SparkSession.builder.appName("qualweave").getOrCreate()
    ensure_workers(spark)
    try:
        (_train if a.command == "train" else _predict)(spark, a)
    except PySparkException as error:
        # Rules that hold within the plan are named at the start of their errors.
        broken = re.search(rf"\b({'|'.join(INVARIANTS)}): [^\n]*", str(error))
        if broken is None:
            raise
        raise SequenceError(broken.group()) from error


if __name__ == "__main__":
    main()
