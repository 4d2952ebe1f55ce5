import hashlib
import math
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle  # noqa: E402

from qualweave.constants import MAX_ID  # noqa: E402
from qualweave.errors import SequenceError  # noqa: E402
from qualweave.functions import predictor, symbols  # noqa: E402
from qualweave.operators import collate, history, metrics, sampler, scores, sinks, split  # noqa: E402
from qualweave.plans import network, packing  # noqa: E402
from qualweave.sources import files, manifest  # noqa: E402
from qualweave.sources.views import VIEWS, Sequences  # noqa: E402

SPARSE = [{30: 6, 31: 2}, {20: 5, 12: 5}, {37: 8, 40: 1, 2: 1}, {9: 0}, {2: 3, 94: 1}, {5: 7}]
OBSERVED = [30, 12, 40, 9, 37, 2]
COUNTS = [[float(s.get(q, 0)) for q in range(95)] for s in SPARSE]
GOLDEN = [
    (0, 0, 30, 0, 94, 95, 189, (63, 511, 4095), (143, 1727, 255, 4095), 0.75, 0.123485, 0.321809, 0.415037),
    (0, 1, 12, 0, 94, 30, 94, (60, 508, 4092), (137, 1721, 249, 4089), 0.50, 0.152210, 0.170213, 1.0),
    (0, 2, 37, 3, 97, 12, 94, (33, 481, 4065), (65, 1649, 177, 4017), 0.80, 0.140327, 0.359574, 3.321928),
    (0, 3, 0, 9, 103, 40, 97, (14, 270, 3854), (68, 788, 3412, 3156), 0.0, 0.0, 0.0, 39.863137),
    (0, 4, 2, 35, 129, 9, 103, (48, 112, 2160), (106, 826, 1274, 1018), 0.75, 0.123485, 0.265957, 39.863137),
    (2, 0, 5, -3, 91, 95, 189, (63, 511, 4095), (143, 1727, 255, 4095), 1.0, 0.0, 0.053191, 39.863137),
]


def toy(spark, reads=((0, [0, 1, 2, 3, 4]), (1, []), (2, [5]))):
    rows = [("t", i, k, OBSERVED[row], str(row)) for i, at in reads for k, row in enumerate(at)]
    positions = spark.createDataFrame(rows, "file string, read_id long, pos int, observed int, pred_key string")
    lengths = spark.createDataFrame([("t", i, len(at)) for i, at in reads], "file string, read_id long, length int")
    vectors = spark.createDataFrame([("t", str(k), c) for k, c in enumerate(COUNTS)], "file string, pred_key string, freqs array<float>")
    return Sequences(lengths, positions), vectors


def all_features(view, vectors):
    df = history.previous(scores.bits(scores.by_predictor(scores.features(view, predictor.described(vectors)))))
    return history.tokens(history.tokens(df, "q"), "r")


def test_golden_rows(spark):
    view, vectors = toy(spark)
    got = {(r.read_id, r.pos): r for r in all_features(view, vectors).collect()}
    assert len(got) == 6
    for read, pos, q_hat, residual, target, pq, pr, qs, rs, top, entropy, expected, bits in GOLDEN:
        r = got[read, pos]
        assert (r.q_hat, r.residual, r.target, r.prev_q, r.prev_r) == (q_hat, residual, target, pq, pr)
        assert (r.qmer_0, r.qmer_1, r.qmer_2) == qs and (r.rmer_0, r.rmer_1, r.rmer_2, r.rmer_3) == rs
        assert (r.max_prob, r.entropy, r.expected_q, r.baseline_bits) == pytest.approx((top, entropy, expected, bits), abs=1e-6)
    total = metrics.compression(all_features(view, vectors)).first()
    assert total.total_symbols == 6 and total.zero_true_freq == 3 and total.h5_baseline_total_bits == pytest.approx(124.326377, abs=1e-5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 94), max_size=12), min_size=1, max_size=4), st.integers(1, 3), st.sampled_from([1, 7, 1000, 4096]))
def test_features_match_scalar_model(spark, reads, stride, vocab):
    keys = ["a", "b"]
    vectors = {"a": [float((q * 7) % 5) for q in range(95)], "b": [0.0] * 40 + [2.0, 9.0] + [0.0] * 53}
    rows = [("f", i, k, o, keys[(i + k) % 2]) for i, read in enumerate(reads) for k, o in enumerate(read)]
    positions = spark.createDataFrame(rows, "file string, read_id long, pos int, observed int, pred_key string")
    freqs = spark.createDataFrame([("f", k, v) for k, v in vectors.items()], "file string, pred_key string, freqs array<float>")
    df = all_features(Sequences(None, positions), freqs)
    df = history.tokens(df.drop("q_bucket"), "q", (5,), stride, vocab)
    got = {(r.read_id, r.pos): r for r in df.collect()}
    for i, read in enumerate(reads):
        expected = oracle.features(read, [vectors[keys[(i + k) % 2]] for k in range(len(read))])
        for k, e in enumerate(expected):
            r = got[i, k]
            assert all(r[c] == e[c] for c in ("q_hat", "residual", "target", "prev_q", "prev_r"))
            assert [r.rmer_0, r.rmer_1, r.rmer_2, r.rmer_3] == e["rmer"] and [r.qmer_1, r.qmer_2] == e["qmer"][1:]
            assert r.qmer_0 == oracle.token([x["q_bucket"] for x in expected], k, 5, stride, 8, 7, vocab)
            assert [r.max_prob, r.entropy, r.expected_q, r.baseline_bits] == pytest.approx([e["max_prob"], e["entropy"], e["expected_q"], e["bits"]], abs=1e-9)


def test_argmax_uses_float_counts(spark):
    counts = [0.0] * 95
    counts[3], counts[9] = 2.0**24, 2.0**24 + 1
    df = spark.createDataFrame([("f", "k", counts)], "file string, pred_key string, freqs array<double>")
    assert predictor.described(df).first().q_hat == 3


@pytest.mark.parametrize(("q", "bucket"), [(0, 0), (9, 0), (10, 1), (19, 1), (20, 2), (24, 2), (25, 3), (29, 3), (30, 4), (34, 4), (35, 5), (39, 5), (40, 6), (94, 6)])
def test_quality_buckets(spark, q, bucket):
    assert spark.range(1).select(symbols.quality_bucket(F.lit(q)).alias("b")).first().b == bucket


def test_residual_buckets_and_legal_classes(spark):
    edges = [-94, *range(-5, 6), 94]
    got = [r.b for r in spark.createDataFrame([(r,) for r in edges], "r int").select(symbols.residual_bucket(F.col("r")).alias("b")).collect()]
    assert got == [min(10, max(0, r + 5)) for r in edges]
    legal = spark.range(95).select(F.size(F.filter(symbols.legal(F.col("id")), lambda x: x)).alias("n")).distinct().collect()
    assert [r.n for r in legal] == [95]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100])
@pytest.mark.parametrize("f", [0.01, 0.29, 0.8, 0.99])
def test_split(spark, n, f):
    train = max(1, min(n - 1, int(n * f)))
    reads = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("read_id"), F.lit(1).alias("length"))
    assert split.split_count(n, f) == train
    ids = {s: {r.read_id for r in split.within(reads, split.bounds(reads, s, f)).collect()} for s in ("train", "test", "all")}
    assert len(ids["train"]) == train and ids["train"] | ids["test"] == ids["all"] and not ids["train"] & ids["test"]


def test_limits_count_empty_reads_and_batches_keep_their_numbers(spark):
    reads = spark.createDataFrame([("f", i, n) for i, n in enumerate((3, 0, 0, 0, 2, 5, 0, 1))], "file string, read_id long, length int")
    got = split.batches(reads, split.bounds(reads, "all", max_reads=7), 2).orderBy("batch_id").collect()
    assert [(r.batch_id, r.reads, r.kept_reads, r.symbols, r.width, r.padded) for r in got] == [(0, 2, 1, 3, 3, 0), (2, 2, 2, 7, 5, 3)]
    with pytest.raises(SequenceError):
        split.bounds(reads, "validation")


def test_offsets_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 7)
    reads = spark.range(100).select(F.lit("f").alias("file"), F.col("id").alias("read_id"), (F.col("id") % 4).cast("int").alias("length"))
    at = 0
    for r in manifest.offsets(reads).orderBy("read_id").collect():
        assert (r.row_start, r.row_stop) == (at, at + r.read_id % 4)
        at = r.row_stop


def test_validation_names_each_fault(spark):
    view, vectors = toy(spark)
    manifest.require_valid(view.reads, view.positions, vectors)
    faults = {
        "observed_range": (view.reads, view.positions.withColumn("observed", F.when(F.col("pos") == 4, 95).otherwise(F.col("observed"))), vectors),
        "row_alignment": (view.reads, view.positions.where("pos <> 4"), vectors),
        "dense_positions": (view.reads, view.positions.withColumn("pos", F.col("pos") * 2), vectors),
        "negative_length": (view.reads.withColumn("length", F.col("length") - 1), view.positions, vectors),
        "all_reads_empty": (view.reads.withColumn("length", F.lit(0)), view.positions.limit(0), vectors),
        "alphabet_width": (view.reads, view.positions, vectors.withColumn("freqs", F.slice("freqs", 1, 94))),
    }
    for name, parts in faults.items():
        with pytest.raises(SequenceError, match=name):
            manifest.require_valid(*parts)
    with pytest.raises(SequenceError, match="lacks observed"):
        manifest.require_valid(view.reads, view.positions.drop("observed"))
    with pytest.raises(SequenceError, match="empty read range"):
        split.read_range(view.positions, manifest.offsets(view.reads), 3, 3)


def test_uniform_and_zero_symbols(spark):
    view, vectors = toy(spark)
    df = scores.bits(scores.uniform(scores.features(view, predictor.described(vectors))))
    assert metrics.compression(df).first().model_avg_bits_per_quality == pytest.approx(6.569856, abs=1e-6)
    with pytest.raises(ValueError, match="zero symbols"):
        metrics.require_symbols(metrics.compression(df.limit(0)))
    sure = metrics.compression(df.withColumn("baseline_bits", F.lit(0.0))).first()
    assert sure.relative_improvement is None


def counter(seed, step, tries, purpose):
    return int(hashlib.md5(f"{seed}:{step}:{tries}:{purpose}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("batch_reads", [1, 2, 50])
def test_sampler_matches_a_plain_sampler(spark, batch_reads):
    lengths = {"a": [0, 0, 0, 4, 0, 0, 2, 0, 0, 0, 0, 0], "b": [1, 0, 0, 0, 0, 0, 0, 0, 3, 0]}
    reads = spark.createDataFrame([(f, i, n) for f, ns in lengths.items() for i, n in enumerate(ns)], "file string, read_id long, length int")
    got = [tuple(r) for r in sampler.plan(spark, reads, 40, batch_reads, seed=4).orderBy("step").select("step", "file", "start", "stop").collect()]
    train = {f: split.split_count(len(ns)) for f, ns in lengths.items()}
    places = [f for f in sorted(train) for _ in range(train[f])]
    expected, tried = [], 0
    for step in range(40):
        for k in range(sampler.TRIES):
            f = places[counter(4, step, k, "file") % len(places)]
            size = min(batch_reads, train[f])
            start = counter(4, step, k, "start") % (train[f] - size + 1)
            if any(lengths[f][start : start + size]):
                expected.append((step, f, start, start + size))
                tried = max(tried, k)
                break
    assert got == expected and (batch_reads > 1 or tried >= sampler.FIRST_TRIES)


def test_sampler_gives_up_on_empty_reads(spark):
    reads = spark.createDataFrame([("a", i, 0) for i in range(9)] + [("a", 9, 5)], "file string, read_id long, length int")
    with pytest.raises(Exception, match="failed to sample a batch with non-empty reads after 100 attempts"):
        sampler.plan(spark, reads, 3, 2).collect()


def test_epoch_average_and_best_epoch(spark):
    steps = [(1, 3.1, 100, 520.0), (1, 2.9, 300, 1500.0), (2, 2.5, 200, 990.0), (2, 2.25, 50, 260.0), (3, 2.5, 10, 51.0)]
    got = {r.epoch: r for r in metrics.epoch_average(spark.createDataFrame(steps, "epoch int, loss double, symbols long, baseline_bits double")).collect()}
    for epoch in (1, 2, 3):
        own = [x for x in steps if x[0] == epoch]
        n = sum(x[2] for x in own)
        assert got[epoch].symbols == n and got[epoch].train_baseline_bits == pytest.approx(sum(x[3] for x in own) / n)
        assert got[epoch].train_bits == pytest.approx(sum(x[1] * x[2] for x in own) / n / math.log(2))
    log = lambda *rows: spark.createDataFrame(rows, "epoch int, val_bits double")
    assert tuple(metrics.best_epoch(log((1, 4.25), (2, 4.125), (3, 4.125), (4, math.nan), (5, 4.5))).first()) == (2, 4.125)
    assert metrics.best_epoch(log((1, math.nan), (2, None))).count() == 0


def test_parsers_and_discovery(tmp_path):
    assert symbols.parse_ks("2, 3,,4") == (2, 3, 4) and symbols.parse_ks("") == ()
    assert symbols.normal_ks([3, -1, 0, 3]) == (3, 3) and symbols.normal_ks(None) == ()
    with pytest.raises(SequenceError):
        symbols.parse_ks("2,0")
    for n in ("SRR2.h5", "SRR1.h5", "other.h5"):
        (tmp_path / n).touch()
    found = files.discover([tmp_path / "other.h5", tmp_path, tmp_path / "SRR1.h5"])
    assert [p.name for p in found] == ["other.h5", "SRR1.h5", "SRR2.h5"]
    with pytest.raises(FileNotFoundError):
        files.discover([tmp_path / "none"])
    (tmp_path / "empty").mkdir()
    with pytest.raises(SequenceError, match="no HDF5 files"):
        files.discover([tmp_path / "empty"])


def test_sinks(spark, tmp_path):
    view, vectors = toy(spark)
    scored = scores.bits(scores.by_predictor(scores.features(view, predictor.described(vectors))))
    lines = [r.line for r in sinks.compact_lines(sinks.first_rows(scored, 2, ["file", "read_id", "pos"])).orderBy("pos").collect()]
    assert lines == ["{30}{?}{0.750000}{30}{?}", "{12}{-}{0.500000}{12}{-}"]
    sinks.write_csv(spark.createDataFrame([('a,"b', 1)], "t string, n int"), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*"))
    assert part.read_bytes() == b't,n\r\n"a,""b",1\r\n'
    sinks.save_json({"é": 1}, tmp_path / "x" / "c.json")
    assert (tmp_path / "x" / "c.json").read_bytes() == '{\n  "é": 1\n}\n'.encode()
    assert symbols.six(0.0000005) == "0.000000" and MAX_ID == 94


def test_six_decimals_match_pythons_format(spark):
    rng = np.random.default_rng(5)
    edges = [0.0, -0.0, 5e-7, -5e-7, 4.9e-7, 0.9999995, 1.0000005, 2.5e-6, 2.0**53, 2.0**62, 2.0**63, 1e22, 1e23, 1.7e308, -1e300, 5e-324, math.nan, math.inf, -math.inf]
    halves = [(2 * k + 1) / 2**7 for k in range(200)] + [w + (2 * k + 1) / 2**7 for w in (3, 77_777, 2**40) for k in range(64)]
    any_bits = [struct.unpack("d", struct.pack("Q", int(b)))[0] for b in rng.integers(0, 1 << 63, 1500)]
    scales = [float(m) * 10.0 ** int(e) for m, e in zip(rng.random(1500), rng.integers(-9, 25, 1500), strict=True)]
    near = [round(float(m) * 100, 6) + 5e-7 for m in rng.random(500)]
    values = [*edges, *halves, *any_bits, *scales, *near, None]
    df = spark.createDataFrame([(v, None if v is None else f"{v:.6f}") for v in values], "v double, wanted string")
    assert df.where(~sinks.decimals(F.col("v")).eqNullSafe(F.col("wanted"))).collect() == []


def test_head_takes_the_reads_that_hold_the_first_symbols(spark):
    lengths = {"a": [3, 0, 2, 4], "b": [0, 5, 1], "c": [7]}
    reads = spark.createDataFrame([(f, 10 + i, n) for f, ns in lengths.items() for i, n in enumerate(ns)], "file string, read_id long, length int")
    places = [(f, 10 + i) for f, ns in lengths.items() for i, n in enumerate(ns) for _ in range(n)]
    for n in (0, 1, 3, 4, 9, 10, 14, 15, 22, 99):
        got = {r.file: (r.start, r.stop, r.rows) for r in split.head(reads, n).collect()}
        some = places[:n]
        assert got == {f: (min(i for g, i in some if g == f), max(i for g, i in some if g == f) + 1, sum(g == f for g, _ in some)) for f in {f for f, _ in some}}


def test_log_reads_only_the_reads_that_it_shows(spark, small):
    from qualweave import queries

    plan = queries.logged([VIEWS["orders"](spark, small)], 20)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "PushedFilters" in line or "FileScan" in line]
    assert any("GreaterThanOrEqual(l_orderkey" in x and "LessThan(l_orderkey" in x for x in scans), plan


def test_padded_batches_hold_every_read_once(spark):
    rng = np.random.default_rng(9)
    lengths = [int(n) for n in rng.integers(0, 30, 60)]
    reads = spark.createDataFrame([("f", i, n) for i, n in enumerate(lengths)], "file string, read_id long, length int")
    cells = [("f", i, k, 100 * i + k, [i, k]) for i, n in enumerate(lengths) for k in range(n)]
    df = spark.createDataFrame(cells, "file string, read_id long, pos int, code int, pair array<int>")
    seen, symbols, padding = [], 0, 0
    for r in collate.padded(df, reads, {"code": -1, "pair": -2}, batch_reads=4, slack=0.25, block_reads=32).collect():
        code = np.array(r["code"]).reshape(len(r["lengths"]), r["width"])
        pair = np.array(r["pair"]).reshape(len(r["lengths"]), r["width"], 2)
        valid = np.array(r["valid"]).reshape(code.shape)
        assert len(r["lengths"]) <= 4 and r["width"] == max(r["lengths"]) and len({i // 32 for i in r["read_ids"]}) == 1
        for i, n, line, two, ok in zip(r["read_ids"], r["lengths"], code, pair, valid, strict=True):
            assert line.tolist() == [100 * i + k for k in range(n)] + [-1] * (r["width"] - n)
            assert two[:n].tolist() == [[i, k] for k in range(n)] and (two[n:] == -2).all() and ok.sum() == n
        seen += r["read_ids"]
        symbols, padding = symbols + sum(r["lengths"]), padding + int((~valid).sum())
    assert sorted(seen) == [i for i, n in enumerate(lengths) if n] and padding <= 0.25 * symbols
    with pytest.raises(SequenceError):
        collate.batches(reads, 0)


@pytest.mark.parametrize("slack", [0.0, 0.1, 0.25, 2.0])
def test_bucket_bounds(slack):
    bounds = collate.bucket_bounds(slack, 5000)
    assert bounds[0] == 1 and all(a < b <= max(a + 1, (a + 1) * (1 + slack)) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def test_rules_hold_within_the_plan(spark):
    view, vectors = toy(spark)
    bad = Sequences(view.reads, view.positions.withColumn("observed", F.when(F.col("pos") == 2, 95).otherwise(F.col("observed"))))
    with pytest.raises(Exception, match="observed_range: 95"):
        scores.features(bad, predictor.described(vectors)).collect()
    with pytest.raises(Exception, match="residual_class: 189"):
        spark.range(1).select(symbols.checked_class(F.lit(189)).alias("c")).collect()
    assert [r.c for r in spark.range(1).select(F.explode(F.array(symbols.checked_class(F.lit(0)), symbols.checked_class(F.lit(188)))).alias("c")).collect()] == [0, 188]
    config = network.Config(d_model=8, heads=2, layers=1, feedforward=8, context=4)
    good = packing.packed(view, predictor.described(vectors), config)
    assert sorted((r.read_id, len(r.seq)) for r in good.collect()) == [(0, 5), (2, 1)]
    faults = [
        Sequences(view.reads, view.positions.where("pos <> 4")),
        Sequences(view.reads, view.positions.where("read_id <> 2")),
        Sequences(view.reads.where("read_id <> 2"), view.positions),
        Sequences(view.reads, view.positions.withColumn("pos", F.col("pos") * 2)),
        Sequences(view.reads.withColumn("length", F.when(F.col("read_id") == 1, -1).otherwise(F.col("length"))), view.positions),
    ]
    for fault in faults:
        with pytest.raises(Exception, match="row_alignment: read [012] of t"):
            packing.packed(fault, predictor.described(vectors), config).collect()


def test_plans(spark, small):
    stored, _ = toy(spark)
    text = history.tokens(stored.positions, "q")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text
    order = VIEWS["orders"](spark, small)
    limited = order.reads.where("read_id < 10")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey,10)" in limited
    blocks = spark.createDataFrame([(0, "orders", 3, 9)], "step long, file string, start long, stop long")
    assert "NestedLoop" not in sampler.blocks_of(order.reads, blocks)._jdf.queryExecution().executedPlan().toString()
