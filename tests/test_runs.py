"""Both command lines on a small table, and the checks that runs begin with."""

import pytest
from pyspark.sql import functions as F
from qualweave import cli
from qualweave.errors import SequenceError
from qualweave.operators import split
from qualweave.plans import network
from qualweave.sources import manifest
from qualweave.sources.views import VIEWS, Sequences

TINY = "--epochs 2 --steps-per-epoch 1 --batch-reads 2 --eval-max-reads-per-file 2 --d-model 8 --num-heads 2 --num-layers 1 --feedforward-dim 8 --context-length 8".split()


def test_train_and_predict(spark, small, tmp_path, capsys):
    cli.main(["train", "--data", small, "--output-dir", str(tmp_path), *TINY])
    lines = (tmp_path / "train_log.csv").read_text().split("\n")
    assert lines[0].startswith("epoch,train_bits_per_quality") and [x[0] for x in lines[1:3]] == ["1", "2"] and len(lines) == 4
    cli.main(["predict", str(tmp_path / "best"), "--data", small, "--max-reads-per-file", "1", "--output-csv", str(tmp_path / "m"), "--sample-predictions", str(tmp_path / "s"), "--sample-reads", "1"])
    said = capsys.readouterr().out
    assert "epoch 1: train" in said and "events: " in said and f"wrote {tmp_path / 'm'}" in said
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() > 40


def test_predict_refuses_bad_values(spark, small, tmp_path, monkeypatch):
    def bad(session, data):
        view = VIEWS["events"](session, data)
        return Sequences(view.reads, view.positions.withColumn("observed", F.when(F.col("pos") == 0, 95).otherwise(F.col("observed"))))

    monkeypatch.setattr(cli, "VIEWS", {"events": bad})
    config = network.Config(d_model=8, heads=2, layers=1, feedforward=8, context=8)
    network.save(tmp_path / "best", config, network.create(config, 1), 1, {})
    for command in (["train", "--output-dir", str(tmp_path), *TINY], ["predict", str(tmp_path / "best"), "--output-csv", str(tmp_path / "m")]):
        with pytest.raises(SequenceError, match="observed_range"):
            cli.main([*command, "--data", small])


def test_predict_scores_once_and_logs_the_first_rows(spark, small, tmp_path, capsys):
    config = network.Config(d_model=8, heads=2, layers=1, feedforward=8, context=8)
    network.save(tmp_path / "best", config, network.create(config, 1), 1, {})
    store = spark._jsparkSession.sharedState().statusStore()

    def scored():
        runs = store.executionsList()
        return sum("MapInPandas" in runs.apply(k).physicalPlanDescription() for k in range(runs.size()))

    before = scored()
    cli.main(["predict", str(tmp_path / "best"), "--data", small, "--max-reads-per-file", "2", "--output-csv", str(tmp_path / "m"), "--no-progress", "--no-quality-prob-log"])
    assert scored() == before + 1
    text = next((tmp_path / "m").glob("part-*")).read_bytes()
    said = capsys.readouterr()
    values = text.split(b"\r\n")[1].decode().split(",")
    assert text.startswith(b"file,total_symbols,") and values[0] == "events" and all(len(v.split(".")[1]) == 6 for v in values[2:7]) and "[" not in said.err
    cli.main(["predict", str(tmp_path / "best"), "--data", small, "--max-reads-per-file", "1", "--output-csv", str(tmp_path / "m"), "--quality-prob-log", str(tmp_path / "log"), "--quality-prob-log-rows", "7", "--no-progress"])
    lines = next((tmp_path / "log").glob("part-*")).read_text().split("\n")
    assert len(lines) == 8 and all(line.count("{") == 5 for line in lines[:7])


def test_eval_limits_are_checked(small, tmp_path):
    for flags in (["train", "--eval-max-reads-per-file", "-1"], ["train", "--train-fraction", "1"], ["predict", str(tmp_path), "--max-reads-per-file", "0"]):
        with pytest.raises(SystemExit):
            cli.main([*flags, "--data", small])


@pytest.mark.parametrize(("bounds", "rows", "what"), [([0, 3, 3, 7], 7, None), ([0], 0, "fewer than two"), ([1, 3], 3, "first"), ([0, 4, 3], 3, "fall"), ([0, 3], 4, "last")])
def test_given_boundaries(spark, bounds, rows, what):
    given = spark.createDataFrame([("f", i, r) for i, r in enumerate(bounds)], "file string, idx long, row long")
    of = spark.createDataFrame([("f", rows)], "file string, rows long")
    if what:
        with pytest.raises(SequenceError, match=what):
            manifest.require_boundaries(given, of)
    else:
        manifest.require_boundaries(given, of)
        assert sorted((r.read_id, r.length) for r in manifest.lengths(given).collect()) == [(0, 3), (1, 0), (2, 4)]


def test_ranges_past_the_end_and_plans(spark, small):
    view = VIEWS["orders"](spark, small)
    with pytest.raises(SequenceError, match="beyond"):
        split.read_range(view.positions, manifest.offsets(view.reads), 1_400, 1_600)
    some = split.within(view.positions, split.bounds(view.reads, "test", max_reads=50))
    plan = some._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert any("GreaterThanOrEqual(o_orderkey" in x or "GreaterThanOrEqual(l_orderkey" in x for x in scans), plan
