import collections
import math
import random

import numpy as np
from helpers import docs, rows
from pyspark.sql import functions as F
from qualweave.llm import near_dedup, words
from qualweave.llm.graphs import components, joined


def bag(t):
    w = (t or "").split()
    if not w:
        return {}
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(data):
    """Classes of equal texts and of weighted Jaccard links, by all pairs."""
    n = len(data)
    bags = [bag(t) for _, t in data]
    df = collections.Counter(s for b in bags for s in b)
    idf = {s: 1 + math.log1p(n / max(k, near_dedup.COMMON * n)) / math.log1p(1 / near_dedup.COMMON) for s, k in df.items()}
    weight = [{s: c * idf[s] for s, c in b.items()} for b in bags]
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = weight[i], weight[j]
            shared = sum(min(v, b[s]) for s, v in a.items() if s in b)
            total = sum(a.values()) + sum(b.values()) - shared
            if (data[i][1] or "") == (data[j][1] or "") or total and shared / total >= near_dedup.SIMILARITY:
                label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        groups[root(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    data = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((6, 12, 40, 150, 400)))]
        data.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, len(base) // 30, len(base) // 8))):
                copy[rng.randrange(len(copy))] = word()
            data.append(" ".join(copy))
    data += [None, "", "", "one two", "one two", "one  two", "x " * 5000, "x " * 5000 + "y"]
    return [(i * 3 + 1, t) for i, t in enumerate(data)]


def test_classes_match_brute_force(spark):
    data = corpus()
    got = near_dedup.near_classes(docs(spark, data).repartition(3)).collect()
    expected = brute(data)
    assert {r.doc_id: r.class_id for r in got} == expected
    sizes = collections.Counter(expected.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    data = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"z{i}"
        data.append((i, " ".join(copy)))
    got = near_dedup.near_classes(docs(spark, data)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {400}


def test_leaders_of_many_tasks_and_batches(spark, monkeypatch):
    """Whatever the tasks of a leader, the batches and the rounds, the links are the same."""
    data = [(2**60 + d, t) for d, t in corpus(8)]
    expected = brute(data)
    monkeypatch.setattr(near_dedup, "PARTNERS", 2)
    monkeypatch.setattr(near_dedup, "PAIRS_A_TEXT", 0.05)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, data)).collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_similarities_of_a_head_and_its_texts():
    rng = random.Random(3)
    texts = ["", "a b", *(" ".join(rng.choices("abc", k=n)) for n in (3, 9, 30, 31, 200))]
    heads, of = texts[::-1], np.repeat(np.arange(len(texts)), len(texts))
    got = near_dedup.similarities(heads, of, texts * len(texts), near_dedup.Weights(10, {}))
    for k, (h, t) in enumerate((h, t) for h in heads for t in texts):
        a, b = collections.Counter(bag(h)), collections.Counter(bag(t))
        shared, union = (a & b).total(), (a | b).total()
        assert abs(got[k] - (shared / union if union else 0.0)) < 1e-12


def test_links_inside_a_family_of_distinct_variants(spark):
    """Two texts are similar to each other, but not to the leaders of their crowded buckets."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(70)]
    family = [[*base[:30], word(), *base[31:]] for _ in range(250)]
    for t in family[100:120]:
        family.append([*t[:50], word(), *t[51:]])
    data = [(i + (i >= 250) * 50, " ".join(t)) for i, t in enumerate(family)] + [(i + 1000, f"{word()} " + " ".join(base[5:60])) for i in range(2)]
    expected = brute(data)
    assert sum(d != c for d, c in expected.items()) >= 20
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, data)).collect()} == expected


def test_odd_rows_and_keep(spark):
    data = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other")]
    got = near_dedup.near_classes(docs(spark, data))
    df = docs(spark, data).withColumns({"__dropped": F.lit("x"), "near_dropped": F.lit("y")})
    assert near_dedup.near_keep(df).columns == df.columns and {r["__dropped"] + r.near_dropped for r in near_dedup.near_keep(df).collect()} == {"xy"}
    assert rows(got, "doc_id", "class_id", "kept") == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False), (3, 3, True)], key=repr)
    kept = near_dedup.near_keep(docs(spark, data))
    assert kept.columns == docs(spark, []).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None", "None"]
    assert near_dedup.near_classes(docs(spark, [])).count() == 0 and near_dedup.near_keep(docs(spark, [])).count() == 0


def test_common_shingles_are_exact(spark):
    line = "a line that very many documents share in full"
    rng = random.Random(2)
    data = [(i, " ".join(f"u{rng.random()}" for _ in range(9)) + (" " + line if i % 4 == 0 else "")) for i in range(800)]
    table = near_dedup.common_shingles(docs(spark, data).repartition(6), "text", 800)
    h, _, _, offsets = words.word_hashes([line.encode()])
    s, _ = words.shingles(h, offsets)
    assert {table[x] for x in s.view(np.int64).tolist()} == {200}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        s = rng.integers(1, 2**63, 300).astype(np.uint64)
        a, b = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
        b[:150] = a[:150]
        two = [near_dedup.samples(s, np.zeros(300, np.int64), w, 1)[0] for w in (a, b)]
        errors.append((two[0] == two[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    # Bins weigh alike whatever their elements weigh, so very uneven weights bias the estimate a little.
    assert abs(np.mean(errors)) < 0.06


def test_samples_of_texts_that_repeat_a_line():
    """A repeated line has its share of the samples: equal samples follow the similarity, and bands are shared."""
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    weights = near_dedup.Weights(1000, {})
    equal = []
    for _ in range(20):
        line = " ".join([own(12)] * 100)
        drawn = []
        for text in (f"{line} {own(150)}", f"{line} {own(150)}"):
            (_, n, s, owner, tf), = near_dedup.bags([text])
            drawn.append(near_dedup.signature(s, owner, tf, n, weights)[0])
        equal.append((drawn[0] == drawn[1]).mean())
        assert (near_dedup.band_hashes(drawn[0]) == near_dedup.band_hashes(drawn[1])).any()
    assert abs(np.mean(equal) - 1189 / (1189 + 2 * 150)) < 0.05


def test_a_repeated_line_and_other_text_are_near(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    data = []
    for i in range(10):
        line = " ".join([own(12)] * 100)
        data += [(2 * i, f"{line} {own(130)}"), (2 * i + 1, f"{line} {own(130)}")]
    expected = brute(data)
    assert expected == {i: i - i % 2 for i in range(20)}
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, data)).collect()} == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30, 2)] + [(i + 1, i) for i in range(1, 30, 2)] + [(100, 101), (102, 101), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_labels_after_further_links(spark):
    pick = random.Random(8)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first = [(pick.randrange(150), pick.randrange(150)) for _ in range(60)]
    later = [(pick.randrange(200), pick.randrange(200)) for _ in range(40)] + [(7, 7), first[0]]
    whole = dict(components(frame(first + later)).collect())
    got = dict(joined(components(frame(first)), frame(later)).collect())
    assert got == whole and len(set(got.values())) > 5
    assert dict(joined(components(frame(first)), frame([])).collect()) == dict(components(frame(first)).collect())
    assert dict(joined(components(frame([])), frame(later)).collect()) == dict(components(frame(later)).collect())


def test_word_hashes_do_not_depend_on_batches():
    texts = ["alpha beta  gamma", "", " beta ", "alpha\tbeta\ngamma delta epsilon zeta"]
    whole = [words.word_hashes([t.encode()])[0].tolist() for t in texts]
    h, _, _, offsets = words.word_hashes([t.encode() for t in texts])
    assert [h[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == whole
    assert whole[0] == whole[3][:3] and whole[2] == whole[0][1:2]


def crowd(seed, texts, copies):
    """A family too alike for bands and not similar, in which some texts have one similar copy each."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(70)]
    family = [[*base[:30], word(), *base[31:]] for _ in range(texts)]
    return [(i, " ".join(t)) for i, t in enumerate(family)] + [(10_000 + i, " ".join([*t[:50], word(), *t[51:]])) for i, t in enumerate(family[:copies])]


def test_no_link_of_a_crowd_is_lost(spark):
    got = near_dedup.near_classes(docs(spark, crowd(1, 1000, 400))).collect()
    assert {r.doc_id: r.class_id for r in got} == {r.doc_id: r.doc_id % 10_000 for r in got}


def test_rest_in_blocks_has_all_links_of_all_pairs(spark, monkeypatch):
    """Whatever the blocks, components and batches, similar texts of two components are among the pairs."""
    data = [*crowd(2, 60, 30), *((d + 50_000, t) for d, t in corpus(6) if t and t.strip())]
    n, texts = len(data), [t for _, t in data]
    shared = spark.sparkContext.broadcast((n, near_dedup.common_shingles(docs(spark, data), "text", n)))
    known = docs(spark, data).select(F.col("doc_id").alias("id"), "text")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "id long, label long")
    label = lambda d: 0 if d < 20 else d
    weights = near_dedup.Weights(*shared.value)
    wanted = set()
    for d, t in data:
        s = near_dedup.similarities([t], np.zeros(n, np.int64), texts, weights)
        wanted |= {(d, e) for (e, _), v in zip(data, s) if d < e and v >= near_dedup.SIMILARITY and label(d) != label(e)}
    assert len(wanted) > 50
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for block, batch in ((2000, 1000), (7, 5), (2, 3)):
            monkeypatch.setattr(near_dedup, "BLOCK", block)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {(r.a, r.b) for r in near_dedup._rest(known, labels, shared).collect()}
            assert wanted <= got and all(label(a) != label(b) for a, b in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
