import numpy as np
import pytest

from qualweave.constants import CLASSES, CONTINUOUS
from qualweave.errors import SequenceError
from qualweave.operators import metrics, split
from qualweave.plans import infer, network, packing, training
from qualweave.queries import described
from qualweave.sources.views import VIEWS
from qualweave.streaming.score import score_stream

TINY = network.Config(q_hat_dim=2, prev_q_dim=2, prev_r_dim=2, q_ks=(2,), r_ks=(2, 3), q_vocab=20, r_vocab=20, q_mer_dim=2, r_mer_dim=2, d_model=6, heads=2, layers=2, feedforward=5, context=4)


def read(n, seed=0):
    rng = np.random.default_rng(seed)
    q_hat = rng.integers(0, 95, n)
    tokens = np.stack([q_hat, rng.integers(0, 96, n), rng.integers(0, 190, n), *(rng.integers(0, 20, n) for _ in range(3))], axis=1)
    return network.Read(rng.normal(size=(n, CONTINUOUS)), tokens, rng.integers(0, 95, n) - q_hat + 94)


def test_banded_attention_matches_dense():
    rng = np.random.default_rng(1)
    q, k, v = (rng.normal(size=(2, 300, 3)) for _ in range(3))
    for context in (1, 7, 256, 500):
        far = np.arange(300)[:, None] - np.arange(300)
        s = q @ k.transpose(0, 2, 1) / np.sqrt(3)
        s[:, (far < 0) | (far >= context)] = -np.inf
        s = np.exp(s - s.max(axis=2, keepdims=True))
        dense = s / s.sum(axis=2, keepdims=True) @ v
        assert np.allclose(network.attend(q, k, v, context)[0], dense)


def test_gradients_match_finite_differences():
    p, r = network.create(TINY, 5), read(9)
    _, g = network.loss_and_gradients(TINY, p, r)
    assert set(g) == set(p)
    rng = np.random.default_rng(2)
    for name in p:
        direction = rng.normal(size=p[name].shape)
        losses = [network.loss_and_gradients(TINY, p | {name: p[name] + e * direction}, r)[0] for e in (1e-6, -1e-6)]
        assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(float((g[name] * direction).sum()), rel=2e-4, abs=1e-5), name


def test_causal_and_masked():
    p, a = network.create(TINY, 5), read(12)
    b = network.Read(a.continuous.copy(), a.tokens.copy(), a.targets)
    b.continuous[8] += 1
    x, y = (network.forward(TINY, p, r)[0] for r in (a, b))
    assert np.allclose(x[:8], y[:8]) and not np.allclose(x[8:], y[8:])
    logp = network.log_softmax(x, a.tokens[:, 0])
    assert np.allclose(np.exp(logp).sum(axis=1), 1) and ((logp > -1e8).sum(axis=1) == 95).all() and x.shape == (12, CLASSES)


def test_shapes_and_checks():
    assert network.Config().width == 314
    assert sum(v.size for v in network.create(network.Config(), 0).values()) == 1_422_445
    assert network.encoding(3, 5).shape == (3, 5) and network.encoding(2, 4)[0].tolist() == [0, 1, 0, 1]
    for bad in ({"layers": 0}, {"d_model": 10, "heads": 4}, {"feedforward": 0}, {"context": 0}):
        with pytest.raises(SequenceError):
            network.Config(**bad)
    with pytest.raises(SequenceError):
        network.forward(TINY, network.create(TINY, 0), network.Read(np.zeros((0, CONTINUOUS)), np.zeros((0, 6), int), np.zeros(0, int)))


def test_training_improves_and_checkpoints_load(spark, small, tmp_path):
    view = VIEWS["events"](spark, small)
    config = network.Config(d_model=16, heads=2, layers=1, feedforward=16, context=8, q_ks=(2,), r_ks=(2,), q_vocab=64, r_vocab=144)
    log = training.train(view, tmp_path, config, epochs=2, steps=4, batch_reads=3, eval_reads=None, rate=1e-2, every_epoch=True)
    assert log[1]["train_bits_per_quality"] < log[0]["train_bits_per_quality"] and len(log[0]) == 10
    loaded, p, info = network.load(tmp_path / "best")
    assert loaded == config and info["epoch"] in (1, 2)
    packed = packing.packed(view, described(view), loaded, split.bounds(view.reads, "test"))
    scored = infer.score(packed, loaded, p)
    again = metrics.compression(scored, by_file=False).first()
    assert again.model_avg_bits_per_quality == pytest.approx(min(x["val_model_avg_bits_per_quality"] for x in log), rel=1e-6)
    packed.write.parquet(str(tmp_path / "packed"))
    got = []
    stream = spark.readStream.schema(packed.schema).parquet(str(tmp_path / "packed"))
    score_stream(stream, loaded, p, lambda df, _: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert sum(r.symbols for r in got) == again.total_symbols
    assert sum(r.model_bits for r in got) == pytest.approx(again.model_total_bits)


def test_lost_mer_settings_mean_none(tmp_path):
    network.save(tmp_path, TINY, network.create(TINY, 1), 3, {})
    text = (tmp_path / "config.json").read_text()
    import json

    info = json.loads(text)
    del info["config"]["q_ks"], info["config"]["r_ks"]
    (tmp_path / "config.json").write_text(json.dumps(info))
    assert network.load(tmp_path)[0].q_ks == () and network.load(tmp_path)[0].r_ks == ()


def test_network_bits_scores_all_test_reads(spark):
    from qualweave import queries

    view = VIEWS["events"](spark, "/root/testdata/sf0.01")
    reads = split.within(view.reads, split.bounds(view.reads, "test")).where("length > 0")
    assert reads.count() > 20
    got = queries.network_bits(view).collect()
    assert sum(r.total_symbols for r in got) == reads.agg({"length": "sum"}).first()[0]
