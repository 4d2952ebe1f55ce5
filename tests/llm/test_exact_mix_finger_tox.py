import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import docs, rows
from qualweave.llm import exact_dedup, fingerprint, mixing, toxicity
from qualweave.session import table

ODD = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "z"), (5, "z"), (5, "z"), (6, "a b "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "é\U0001f642")]


def brute_classes(data):
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in data:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table_bytes", [1 << 26, 2_000, 1])
def test_exact_classes_match_brute_force(spark, table_bytes):
    got = exact_dedup.exact_classes(docs(spark, ODD), table_bytes=table_bytes)
    assert rows(got) == brute_classes(ODD)


def test_exact_many_copies_and_recursion(spark):
    rng = random.Random(1)
    data = [(i, "hot text" if i % 3 == 0 else f"text {rng.randrange(400)} " + "y" * 50) for i in range(3000)]
    df = docs(spark, data).repartition(7)
    assert rows(exact_dedup.exact_classes(df, table_bytes=300)) == brute_classes(data)
    kept = exact_dedup.exact_keep(df, table_bytes=300)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[1] for r in brute_classes(data)})


def test_exact_empty_table(spark):
    assert exact_dedup.exact_classes(docs(spark, [])).count() == 0
    assert exact_dedup.exact_keep(docs(spark, [])).count() == 0


def test_open_addressing_compares_contents():
    t = exact_dedup.ContentTable()
    assert [t.add(5, bytes([i % 3]), i, 1)[0] for i in range(2000)] == [i % 3 for i in range(2000)]
    assert t.rows[:3] == [667, 667, 666]
    u = exact_dedup.ContentTable()
    for i in range(5000):
        u.add(7, str(i).encode(), i, 1)
    assert len(u.contents) == 5000 and u.add(7, b"4321", 0, 1) == (4321, False)


def brute_mix(data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, s in data:
        by.setdefault(s, []).append((int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), size(t)))
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(n for _, n in by[s]) for s in by}
    need, open_, target = 1.5 * sum(total.values()), set(by), {}
    while open_:
        level = need / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        need -= sum(2.0 * total[s] for s in full)
        open_ -= full
    return total, target


def test_mix_targets_and_limits(spark):
    data = [(i, "w " * (i % 17), f"s{i % 4}") for i in range(400)] + [(1000 + i, "v v v", None) for i in range(50)] + [(None, "q q", "s1"), (2000, None, "s2"), (2001, "", "empty"), (2002, "big " * 3000, "s0")]
    got = mixing.mix(docs(spark, data)).collect()
    total, target = brute_mix(data)
    source = {i: s for i, _, s in data}
    assert len(got) == len(data)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    assert sum(target.values()) <= 1.5 * sum(total.values()) + 1e-6
    for s in total:
        largest = max([r.size for r in got if source[r.doc_id] == s])
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    assert rows(mixing.mix(docs(spark, data).repartition(5))) == rows(mixing.mix(docs(spark, data)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mix_of_real_tables_reaches_its_targets(spark, sf):
    d = table(spark, f"/root/testdata/{sf}", "documents")
    data = [(r.doc_id, r.text, r.source) for r in d.select("doc_id", "text", "source").collect()]
    total, target = brute_mix(data)
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    taken, largest, source = dict.fromkeys(total, 0), dict.fromkeys(total, 0), {i: s for i, _, s in data}
    for r in mixing.mix(d).collect():
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s]) and 0 <= r.target <= 2 * total[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s], largest[s] = taken[s] + r.taken, max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in total)


def test_mixed_repeats_rows_and_keeps_columns(spark):
    data = [(i, "w " * (i % 17), f"s{i % 4}") for i in range(200)] + [(500, None, None), (501, "a b", None), (1, "w ", "s1")]
    df = docs(spark, data).withColumns({c: F.lit("x") for c in ("__times", "__whole", "mix_time", "mix_source", "mix_Whole")})
    times = {}
    for r in mixing.mix(df).collect():
        if r.size:
            times[r.doc_id] = r.taken // r.size
    got = mixing.mixed(df)
    assert got.columns == df.columns
    seen = [r for r in got.collect() if r.text and r.text.strip()]
    assert seen and all(r.mix_time == r.mix_source == r["__times"] == "x" for r in seen)
    copies = dict.fromkeys(times, 0)
    for r in seen:
        copies[r.doc_id] += 1
    assert copies == {i: n * (2 if i == 1 else 1) for i, n in times.items()}
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_mix_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_nested_budgets(spark):
    sized = docs(spark, [(i, "a " * (i % 9 + 1)) for i in range(300)]).select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), mixing.hash_of(F.col("doc_id")).alias("h"))
    cut = [mixing.thresholds(sized.select("source", "size", "h"), spark.createDataFrame([("s", b)], "source string, budget long")).first().threshold for b in (0, 100, 700, 10**9)]
    assert cut == sorted(cut)


def brute_edited(data):
    data = sorted(data)
    out = {}
    for k, (i, t) in enumerate(data):
        nxt, n = data[(k + 1) % len(data)][1] or "", len(t or "")
        out[i] = (t or "")[: n - n // 2] + nxt[: n // 2]
    return out


def test_fingerprint_edits_and_likeness(spark, small):
    d = table(spark, small, "documents")
    data = [(r.doc_id, r.text) for r in d.collect()]
    got = {r.doc_id: r for r in fingerprint.fingerprints(d).collect()}
    edited = brute_edited(data)
    assert len(got) == len(data)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    errors = []
    for i, t in data:
        assert got[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingles(t), shingles(edited[i])
        if len(a) > 100:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.12


def test_fingerprint_odd_rows(spark):
    data = [(None, "n1 n2 n3 n4 n5 n6"), (1, None), (2, ""), (3, "one two"), (4, "one two"), (7, "é\U0001f642x"), (9, "w " * 60_000)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, data), scale=1).collect()}
    assert got[1].near_next == 1.0 and got[2].near_next == 0.0 and got[3].near_next == 1.0
    assert got[7].n_chars == 3 and got[7].edited_sha256 == hashlib.sha256("é\U0001f642w".encode()).hexdigest()
    assert got[9].edited_sha256 == hashlib.sha256(("w " * 30_000 + "n1 n2 n3 n4 n5 n6").encode()).hexdigest()
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    alone = fingerprint.fingerprints(docs(spark, [(5, "a b c d e f")])).first()
    assert alone.near_next == 1.0


def test_fingerprint_merge_and_containment(spark):
    long, short = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(500, 700))
    df = fingerprint.add_fingerprint(spark.createDataFrame([(long, short)], "a string, b string"), "a", "fa")
    df = fingerprint.add_fingerprint(df, "b", "fb")
    r = df.select(fingerprint.containment(F.col("fb"), F.col("fa")).alias("c"), (fingerprint.merged(F.col("fa"), F.col("fb")) == F.col("fa")).alias("m")).first()
    assert r.c == 1.0 and r.m


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randrange(2, 7)))
    data, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["Moronix", "scumbert", "idiotes"])
        data.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels += [(5000, 1, None), (None, 1, 1), (3, 0, 0)]
    data += [(901, None), (902, ""), (903, "moronix scumbert")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, data), lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[901].score == got[902].score and 0 <= got[901].score <= 1 and got[903].predicted == 1
    flipped = spark.createDataFrame([(i, q, 1 - t if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, data), flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = toxicity.drop_toxic(docs(spark, data), lab)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5} and kept.columns == docs(spark, []).columns


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs(spark, [(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def test_long_text_features_match_whole():
    text = "abc defg " * 40
    whole = toxicity.Features()(text)
    was, toxicity.SLICE = toxicity.SLICE, 50
    try:
        assert (toxicity.Features()(text) == whole).all()
    finally:
        toxicity.SLICE = was


CLASH = ("__score", "score", "__leaf", "__rank", "__rows", "grace_rows", "Grace_leaf", "grace_rank", "__place", "place", "r", "toxic", "__text", "__fp")


def test_columns_of_clashing_names_are_kept(spark):
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice(["foul", "word"] if i % 3 else ["kind", "word"]) for _ in range(40)) + f" {i}") for i in range(60)] + [(1, "again"), (1, None), (1, None)]
    df = docs(spark, data).withColumns({c: F.lit(c) for c in CLASH})
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and all(r[c] == c for r in kept.collect() for c in CLASH)
    assert {r.doc_id: r.score for r in toxicity.toxicity(df, labels).collect()} == {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, data), labels).collect()}
    once = exact_dedup.exact_keep(df)
    assert once.columns == df.columns and all(r[c] == c for r in once.collect() for c in CLASH) and once.count() == len({t or "" for _, t in data})
    assert rows(exact_dedup.exact_classes(df)) == brute_classes(data)
    assert rows(fingerprint.fingerprints(df)) == rows(fingerprint.fingerprints(docs(spark, data)))
    assert rows(mixing.mix(df)) == rows(mixing.mix(docs(spark, data)))


def test_toxicity_fit_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda features, labels, seed=7: seen.append(len(features)) or toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32), 0.0))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    toxicity.train(docs(spark, [(i % 20, f"text {i}") for i in range(2000)]), labels, fit_rows=10)
    assert seen == [10]


def test_scores_match_a_plain_model():
    """The fit against the same classifier written with whole vectors, on a small set."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["abc", "xyz", "mno"] if i % 2 else ["abc", "xyz", "qrs"]) for _ in range(6)) for i in range(40)]
    labels, features = np.array([i % 2 for i in range(40)]), toxicity.Features()
    packed = [toxicity._packed(features(t)) for t in texts]
    model = toxicity.fit(packed, labels)
    counts = np.ones((2, toxicity.BUCKETS))
    for t, y in zip(texts, labels, strict=True):
        counts[y][sorted(set(features(t).tolist()))] += 1
    ratio = np.log(counts[1] / 22) - np.log(counts[0] / 22)
    assert np.allclose(ratio, model.ratio, atol=1e-5)
    for t in texts:
        x = np.zeros(toxicity.BUCKETS)
        f = features(t)
        x[f] = ratio[f]
        x /= np.sqrt(np.linalg.norm(x))
        assert abs(1 / (1 + np.exp(-(x @ model.weight + model.bias))) - toxicity.score(model, features, t)) < 1e-4


def test_tables_hold_winning_rows_and_not_their_batches():
    """One long text whose id rises row by row, beside short texts that stay."""
    import pyarrow as pa

    long, limit = "x" * 500_000, 16 << 20
    names = ("leaf", "rank", "rows")

    def source():
        for b in range(60):
            texts = [t for k in range(10) for t in (long, f"short {b} {k}")]
            yield pa.RecordBatch.from_pydict({"text": texts, "leaf": ["a"] * 20, "rank": pa.array(range(20 * b, 20 * b + 20), pa.int64()), "rows": pa.array([1] * 20, pa.int64())})

    for counted in (False, True):
        pool = pa.default_memory_pool()
        before, most, out = pool.bytes_allocated(), 0, []

        def watched():
            nonlocal most
            for batch in source():
                yield batch
                most = max(most, pool.bytes_allocated() - before)

        for batch in exact_dedup._Reducer("text", names, limit, counted)(watched()):
            out += batch.to_pylist()
        assert most < 2 * limit + 20 * len(long)
        whole = {}
        for row in out:
            rank, rows = whole.get(row["text"], (-1, 0))
            whole[row["text"]] = max(rank, row["rank"]), rows + row["rows"]
        assert len(whole) == 601 and whole[long] == (1198, 600)
        assert all(rows == 1 for text, (_, rows) in whole.items() if text != long)


def test_fit_leaves_the_driver_alone(spark, monkeypatch):
    """Rows for the fit meet in a task; the model is that of a fit over them."""
    from qualweave.session import ensure_workers

    ensure_workers(spark)
    data = docs(spark, [(i, f"bad words {i}" if i % 3 == 0 else f"kind text {i}") for i in range(60)])
    labels = data.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    own, fit = toxicity.Features(), toxicity.fit
    places = {r.doc_id: r.p for r in data.select("doc_id", F.xxhash64("doc_id", "text").alias("p")).collect()}
    rows_ = sorted(data.select("doc_id", "text").collect(), key=lambda r: places[r.doc_id])
    wanted = fit([toxicity._packed(own(r.text)) for r in rows_], np.array([int(r.doc_id % 3 == 0) for r in rows_]))

    def never(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity, "fit", never)
    got = toxicity.train(data, labels)
    assert (got.ratio == wanted.ratio).all() and (got.weight == wanted.weight).all() and (got.bias, got.fitted) == (wanted.bias, True)
