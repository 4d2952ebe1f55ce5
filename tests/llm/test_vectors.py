"""Top-k search and hard negatives against brute force over all rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from qualweave.llm import hard_negatives, segment_search
from qualweave.llm import vector_blocks as vb
from qualweave.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, row int, block string, key int, tile int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "b", 2, 3) for i, v, label in rows], VECTORS)


def whole(v, scale):
    """The integers of a vector that takes part, else None."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(x)) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain_top(rows, k=20, scale=64, every=20):
    rows = [(i, whole(v, scale)) for i, v, _ in rows]
    rows = [(i, x) for i, x in rows if i is not None and x is not None]
    out = []
    for n, (q, x) in enumerate(rows):
        if q % every == 0:
            found = sorted((-product(x, y), i) for m, (i, y) in enumerate(rows) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def plain_mined(rows, every=100, positives=5, negatives=10, scale=256):
    rows = [(i, whole(v, scale), label) for i, v, label in rows]
    rows = [r for r in rows if None not in r]
    out = []
    for n, (anchor, x, label) in enumerate(rows):
        if anchor % every:
            continue
        all_ = sorted((-product(x, y), i, other) for m, (i, y, other) in enumerate(rows) if m != n)
        for s, p, _ in [r for r in all_ if r[2] == label][:positives]:
            inside = [(i, -t) for t, i, other in all_ if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(anchor, p, rank, i, -s, t) for rank, (i, t) in enumerate(inside, 1)]
    return sorted(out)


def random_rows(seed, n, width=16, labels=3, copies=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * 0.5 + rng.normal(size=width)
        if out and rng.random() < copies:
            v = np.array(out[0][1])
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], label))
    return out


def answers(df):
    return sorted(tuple(r) for r in df.collect())


ODD = [
    (0, [1.0, 0.5, -0.25], 0),
    (0, [0.5, 0.5, 0.5], 0),  # an id that repeats, with another vector
    (0, [1.0, 0.5, -0.25], 0),  # and with the same one
    (20, [], 1),
    (40, None, 1),
    (60, [float("nan"), 1.0, 1.0], 1),
    (80, [float("inf"), 1.0, 1.0], 1),
    (100, [None, 1.0, 1.0], 0),
    (None, [1.0, 1.0, 1.0], 0),
    (200, [1.0], 0),  # shorter
    (300, [1.0, 2.0, 3.0, 4.0, 5.0], None),  # longer, without a label
    (400, [0.0, 0.0, 0.0], 0),
    (7, [0.9, 0.5, -0.25], 1),
    (9, [0.8, 0.5, -0.25], 1),
]


def test_top_k_small_and_odd_rows(spark):
    assert answers(segment_search.top_k(vectors(spark, ODD))) == plain_top(ODD)
    assert answers(segment_search.top_k(vectors(spark, []))) == []
    few = ODD[:3]
    assert answers(segment_search.top_k(vectors(spark, few), k=2)) == plain_top(few, k=2)
    assert segment_search.top_k(vectors(spark, few)).columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_over_many_blocks_and_a_hot_vector(spark):
    rows = random_rows(1, 900, copies=0.4)
    # 40 rows a block: crowded sign patterns have many blocks, and ties cross them.
    assert answers(segment_search.top_k(vectors(spark, rows).repartition(7), rows=40)) == plain_top(rows)


def test_numbers_beyond_doubles_stay_exact(spark):
    rows = [(20 * i, [float(2**24 + i), float(2**24 - i), 1.0], i % 2) for i in range(30)]
    assert answers(segment_search.top_k(vectors(spark, rows), k=5)) == plain_top(rows, k=5)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 12))
def test_levels_bound_products_and_tighten(seed, width, n):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, size=(n, width))
    true, before = x @ x.T, np.inf
    for level in segment_search.levels(x):
        bound = level @ level.T
        assert (bound >= true - 1e-6).all() and (bound <= before + 1e-6).all()
        before = bound


def test_coarse_levels_drop_far_candidates():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full((50, 32), 40) + rng.integers(-3, 4, (50, 32)), rng.integers(-3, 4, (4000, 32)) - 40])
    q = x[:20]
    best = np.sort(q @ x[:50].T, axis=1)[:, -6].astype(float)
    coarse = segment_search.levels(x)[0]
    assert ((coarse[:20] @ coarse.T >= best[:, None]).sum(1) <= 50).all()
    i, j, score = segment_search.search(q, best - 1, np.full(20, vb.LONG_MAX), x, np.arange(len(x)), np.arange(20), 5)
    assert len(i) == 100 and j.max() < 50 and (score == (q[i] * x[j]).sum(1)).all()


def test_mining_small_and_odd_rows(spark):
    assert answers(hard_negatives.mine(vectors(spark, ODD))) == plain_mined(ODD)
    assert answers(hard_negatives.mine(vectors(spark, []))) == []


@pytest.mark.parametrize(("copies", "rows_a_block"), [(0.0, 4096), (0.4, 50)])
def test_mining_over_blocks_labels_and_copies(spark, copies, rows_a_block):
    rows = random_rows(5, 700, labels=3, copies=copies)
    rows = [(i, v, (label + 1) % 3 if i % 7 == 0 else label) for i, v, label in rows]
    found = hard_negatives.mine(vectors(spark, rows).repartition(5), every=20, rows=rows_a_block, tile=16)
    assert answers(found) == plain_mined(rows, every=20)
    assert len(plain_mined(rows, every=20)) > 500


def test_many_sparse_labels_share_blocks(spark):
    rows = [(i, v, i // 3) for i, v, _ in random_rows(6, 300)]
    assert answers(hard_negatives.mine(vectors(spark, rows), every=10, rows=64, tile=8)) == plain_mined(rows, every=10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 24), st.integers(-2000, 9000))
def test_threshold_pairs_lose_nothing(seed, width, least):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-30, 60, size=(40, width)), rng.integers(-30, 60, size=(6, width))
    floor = least + rng.integers(0, 500, 6)
    i, j, s = hard_negatives.threshold_pairs(q, floor.astype(float), x, rng.permutation(width))
    true = q @ x.T
    assert sorted(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == [(a, b, int(true[a, b])) for a in range(6) for b in range(40) if true[a, b] >= floor[a]]


def test_index_leaves_out_what_norms_cover():
    rng = np.random.default_rng(7)
    x = rng.integers(-100, 100, size=(200, 64))
    norm = np.sqrt((x * x).sum(1))
    high, none = (hard_negatives.Index(x, np.arange(64), r) for r in (0.8 * norm.max(), -1.0))
    assert high.kept.mean() < 0.5 * none.kept.mean() == 32


def test_queries_on_given_vectors(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert answers(QUERIES["op11_segment_search"](spark, small)) == plain_top(rows)
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    found = QUERIES["op13_hard_negatives"](spark, small)
    assert answers(found) == plain_mined(rows) and found.count() == found.select(F.count("rank")).first()[0]
