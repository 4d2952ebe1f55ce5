"""The HDF5 source over a stand-in for its reader library, flat rows, and the progress bar."""

import io
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from qualweave import progress
from qualweave.errors import SequenceError
from qualweave.sources import files, manifest
from qualweave.sources.views import flat

#: A module h5py that reads arrays from an .npz of the file's name; it counts the values read.
STAND_IN = '''
import numpy as np
class _Set:
    def __init__(self, a): self.a, self.shape = a, a.shape
    def __getitem__(self, s): return self.a[s]
class File:
    def __init__(self, path, mode="r"): self.z = np.load(open(path, "rb"))
    def __enter__(self): return self
    def __exit__(self, *e): return False
    def __contains__(self, n): return n in self.z
    def __getitem__(self, n): return _Set(self.z[n])
'''
LENGTHS = [3, 0, 0, 2, 5, 0, 1]


@pytest.fixture(scope="module")
def h5(tmp_path_factory, request):
    where = tmp_path_factory.mktemp("h5")
    (where / "h5py.py").write_text(STAND_IN)
    sys.path.insert(0, str(where))
    sys.modules.pop("h5py", None)
    request.addfinalizer(lambda: (sys.path.remove(str(where)), sys.modules.pop("h5py", None)))
    return where


def stored(where, name, **change):
    rows = sum(LENGTHS)
    arrays = {"observed": np.arange(rows) % 95, "freqs": np.arange(rows * 95).reshape(rows, 95) % 7, "read_offsets": np.concatenate([[0], np.cumsum(LENGTHS)])} | change
    with open(where / name, "wb") as f:
        np.savez(f, **{k: v for k, v in arrays.items() if v is not None})
    return str((where / name).resolve())


def expected(path):
    rows = [(i, k) for i, n in enumerate(LENGTHS) for k in range(n)]
    return [(path, i, k, at, at % 95, [float(v) for v in np.arange(at * 95, at * 95 + 95) % 7]) for at, (i, k) in enumerate(rows)]


def read(reader):
    return [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in pa.Table.from_batches([batch]).to_pylist()]


@pytest.mark.parametrize("reads_a_task", [1, 2, 100])
@pytest.mark.parametrize("chunk", [1, 2, 1 << 16])
def test_ranges_and_chunks_give_all_positions(h5, monkeypatch, reads_a_task, chunk):
    monkeypatch.setattr(files, "CHUNK", chunk)
    path = stored(h5, "a.h5")
    options = {"path": path, "reads_a_task": str(reads_a_task)}
    assert read(files._Reader(options)) == expected(path)
    assert read(files._Reader(options | {"table": "reads"})) == [(path, i, n) for i, n in enumerate(LENGTHS)]
    assert read(files._Reader(options | {"table": "boundaries"})) == [(path, i, int(r)) for i, r in enumerate(np.concatenate([[0], np.cumsum(LENGTHS)]))]


def test_conditions_narrow_the_ranges(h5):
    a, b = stored(h5, "a.h5"), stored(h5, "b.h5")
    reader = files._Reader({"path": f"{a},{b}"})
    other = StringStartsWith(("file",), "x")
    given = [EqualTo(("file",), b), In(("file",), (a, b)), GreaterThan(("read_id",), 0), GreaterThanOrEqual(("read_id",), 3), LessThan(("read_id",), 6), LessThanOrEqual(("read_id",), 4), IsNotNull(("read_id",)), other]
    assert list(reader.pushFilters(given)) == [other]
    assert [(p.path, p.start, p.stop) for p in reader.partitions()] == [(b, 3, 5)]
    assert read(reader) == [r for r in expected(b) if 3 <= r[1] <= 4]
    nothing = files._Reader({"path": a})
    assert list(nothing.pushFilters([EqualTo(("read_id",), 99)])) == [] and read(nothing) == []


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({"freqs": None}, "lacks freqs"),
        ({"observed": np.zeros((11, 1))}, "one dimension"),
        ({"freqs": np.zeros((10, 95))}, "observed has 11 rows, freqs 10"),
        ({"freqs": np.zeros((11, 94))}, "94 columns"),
        ({"read_offsets": np.array([0])}, "fewer than two"),
        ({"read_offsets": np.array([1, 11])}, "first isn't 0"),
        ({"read_offsets": np.array([0, 5, 4, 11])}, "they fall"),
        ({"read_offsets": np.array([0, 5, 10])}, "last isn't"),
        ({"observed": np.zeros(0), "freqs": np.zeros((0, 95)), "read_offsets": np.array([0, 0])}, "all reads are empty"),
    ],
)
@pytest.mark.parametrize("chunk", [1, 1 << 16])
def test_files_are_checked_before_a_task_starts(h5, monkeypatch, change, what, chunk):
    monkeypatch.setattr(files, "CHUNK", chunk)
    path = stored(h5, "bad.h5", **change)
    with pytest.raises(SequenceError, match=what):
        files._Reader({"path": path}).partitions()


def test_spark_reads_the_source(spark, h5):
    path = stored(h5, "a.h5")
    spark.sparkContext.addPyFile(str(h5 / "h5py.py"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(files.Hdf5Source)
        df = spark.read.format("quality_h5").option("path", path).option("reads_a_task", "2").load()
        assert sorted(tuple(r) for r in df.collect()) == expected(path)
        some = df.where("read_id >= 3 and read_id < 5 and observed % 2 = 0")
        assert sorted(tuple(r) for r in some.collect()) == [r for r in expected(path) if 3 <= r[1] < 5 and r[4] % 2 == 0]
        reads = spark.read.format("quality_h5").option("path", path).option("table", "reads").load()
        assert [r.length for r in reads.orderBy("read_id").collect()] == LENGTHS
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_flat_rows_are_parted_by_checked_boundaries(spark):
    rows = spark.createDataFrame([("f", k, k % 95, "p") for k in range(sum(LENGTHS))], "file string, row long, observed int, pred_key string")
    edges = [0, *np.cumsum(LENGTHS).tolist()]
    given = lambda edges: spark.createDataFrame([("f", i, int(r)) for i, r in enumerate(edges)], "file string, idx long, row long")
    view = flat(rows, given(edges))
    assert [(r.read_id, r.length) for r in view.reads.orderBy("read_id").collect()] == list(enumerate(LENGTHS))
    assert sorted((r.read_id, r.pos, r.observed) for r in view.positions.collect()) == [(i, k, at) for _, i, k, at, *_ in expected("")]
    manifest.require_valid(view.reads, view.positions, boundaries=view.boundaries)
    with pytest.raises(SequenceError, match="f: they fall"):
        flat(rows, given([0, 5, 3, 11]))
    with pytest.raises(SequenceError, match="falling_boundaries: 1"):
        manifest.require_valid(view.reads, view.positions, boundaries=given([0, 5, 3, 11]))


def test_falls_are_found_within_and_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for f in range(6):
        edges = np.sort(rng.integers(0, 100, 23))
        edges[0], edges[-1] = 0, 100
        if f:
            edges[rng.integers(1, 22, f)] = rng.integers(0, 100, f)
        rows += [(f"f{f}", i, int(e)) for i, e in enumerate(edges)]
        wanted[f"f{f}"] = (int((np.diff(edges) < 0).sum()), int(edges[0] != 0), int(edges[-1] != 100), 0)
    rows = [r for r in rows if r[:2] != ("f5", 7)]  # a gap in the places
    edges = [r[2] for r in rows if r[0] == "f5"]
    wanted["f5"] = (int((np.diff(edges) < 0).sum()), *wanted["f5"][1:3], 1)
    sizes = spark.createDataFrame([(f"f{f}", 100) for f in range(6)], "file string, rows long")
    found = manifest.boundary_faults(spark.createDataFrame(rows, "file string, idx long, row long"), sizes)
    got = {r.file: (r.falling_boundaries, r.first_boundary, r.last_boundary, r.boundary_places) for r in found.collect()}
    assert got == wanted and sum(w[0] for w in wanted.values()) > 3
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_validation_scans_each_table_once(spark, small):
    from qualweave.sources.views import VIEWS

    view = VIEWS["events"](spark, small)
    plan = manifest.violations(view.reads, view.positions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_bar_draws_over_itself():
    out, times, states = io.StringIO(), iter([0.0, 1.4, 2.6, 3.0]), iter([(0, 0), (5, 10), (10, 10)])
    bar = progress.Bar("score", lambda: next(states), out, lambda: next(times))
    for _ in range(3):
        bar.draw()
    bar.close()
    lines = out.getvalue().split("\r")
    assert lines[1].startswith(f"score [{'.' * 30}] 0/0 tasks, 1 s")
    assert lines[2].startswith(f"score [{'#' * 15}{'.' * 15}] 5/10 tasks, 3 s")
    assert lines[3].startswith(f"score [{'#' * 30}] 10/10 tasks, 3 s") and lines[-2].strip() == "" and lines[-1] == ""


def test_bar_beside_a_job_ends_with_it(spark):
    out = io.StringIO()
    with progress.shown(spark, "count", every=0.01, out=out):
        assert spark.range(10**6).repartition(8).where(F.rand() < 2).count() == 10**6
    assert "count [" in out.getvalue() and out.getvalue().endswith("\r")
    with pytest.raises(ZeroDivisionError), progress.shown(spark, "fails", every=0.01, out=io.StringIO()):
        1 / 0
    quiet = io.StringIO()
    with progress.shown(spark, "quiet", on=False, out=quiet) as bar:
        assert bar is None
    assert quiet.getvalue() == ""


TINY = "--epochs 1 --steps-per-epoch 1 --batch-reads 2 --eval-batch-reads 1 --d-model 8 --num-heads 2 --num-layers 1 --feedforward-dim 8 --context-length 8 --no-progress".split()


def test_own_counts_give_the_features_of_joined_vectors(spark, h5):
    from pyspark.sql import functions as F
    from qualweave.functions import predictor
    from qualweave.operators import scores
    from qualweave.sources.views import Sequences, stored as view_of

    spark.sparkContext.addPyFile(str(h5 / "h5py.py"))
    view = view_of(spark, [stored(h5, "a.h5"), stored(h5, "b.h5")], reads_a_task=2)
    assert view.own_counts
    keyed = view.positions.withColumn("pred_key", F.concat_ws("/", "read_id", "pos"))
    joined = scores.features(Sequences(view.reads, keyed.drop("freqs")), predictor.described(keyed.select("file", "pred_key", "freqs")))
    columns = ["file", "read_id", "pos", "observed", "q_hat", "max_prob", "entropy", "expected_q", "p_true", "true_freq", "residual", "target"]
    own = scores.features(view)
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in own.select(columns).orderBy(*columns[:3]).collect()]
    assert len(got) == 2 * sum(LENGTHS) and got == [tuple(r) for r in joined.select(columns).orderBy(*columns[:3]).collect()]


def test_command_lines_read_hdf5_files(spark, h5, tmp_path, monkeypatch, capsys):
    import csv
    import json

    from qualweave import cli

    spark.sparkContext.addPyFile(str(h5 / "h5py.py"))
    (tmp_path / "h5").mkdir()
    names = [stored(tmp_path / "h5", n) for n in ("SRR2.h5", "SRR1.h5")]
    stored(tmp_path / "h5", "other.h5")
    monkeypatch.chdir(tmp_path)
    cli.main(["train", "--output-dir", "out", *TINY, "--eval-max-reads-per-file", "0"])
    about = json.loads((tmp_path / "out/config.json").read_text())
    assert about["input_files"] == sorted(names) and about["inputs"] == ["h5"] and about["files"][0]["empty_reads"] == LENGTHS.count(0)
    assert (tmp_path / "out/train_log.csv").read_text().count("\n") == 2

    def table(where, *flags):
        cli.main(["predict", "out/best", *flags, "--output-csv", str(tmp_path / where), "--no-progress", "--device", "cpu"])
        with next((tmp_path / where).glob("part-*")).open(newline="") as f:
            return list(csv.DictReader(f))

    every = table("all", "--split", "all")
    assert [r["file"] for r in every] == sorted(names)
    rows = expected(names[0])
    bits = sum(-np.log2(max(freqs[observed] / sum(freqs), 1e-12)) for *_, observed, freqs in rows) / len(rows)
    assert all(int(r["total_symbols"]) == len(rows) and float(r["h5_baseline_avg_bits_per_quality"]) == pytest.approx(bits, abs=1e-6) for r in every)
    # One file by name, and batches of one read: the same numbers.
    assert table("one", names[0], "--split", "all", "--batch-reads", "1") == [r for r in every if r["file"] == names[0]]
    assert [int(r["total_symbols"]) for r in table("test", "h5")] == [sum(LENGTHS[5:])] * 2
    # Faults: nothing found, an id outside the alphabet, an empty batch.
    with pytest.raises(FileNotFoundError):
        table("none", "missing.h5")
    with pytest.raises(SequenceError, match="observed_range"):
        table("bad", stored(tmp_path, "bad.h5", observed=np.full(sum(LENGTHS), 95)), "--split", "all")
    for flags in (["train", "--eval-batch-reads", "0"], ["predict", "out/best", "--batch-reads", "0"]):
        with pytest.raises(SystemExit):
            cli.main(flags)
