import itertools
import math
from collections import Counter

import numpy as np
import pytest
from helpers import docs
from pyspark.sql import functions as F
from qualweave.llm import sentencepiece_lattice as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load()


def segmentations(v, text):
    """All segmentations of a text with their normalised log-probabilities."""
    out = {}

    def go(at, ids, lp):
        if at == len(text):
            out[tuple(ids)] = lp
            return
        for end in range(at + 1, len(text) + 1):
            i = v.ids.get(text[at:end])
            if i is not None:
                go(end, [*ids, i], lp + v.logp[i])
            elif end == at + 1:
                b = text[at].encode()
                go(end, [*ids, *(v.bytes[x] for x in b)], lp + v.spelt * len(b))

    go(0, [], 0.0)
    total = math.log(sum(math.exp(x) for x in out.values()))
    return {k: x - total for k, x in out.items()}


@pytest.mark.parametrize("text", ["the cat", "aé\n b", "漢 in", "\U0001f642"])
def test_samples_are_distinct_segmentations_with_their_probabilities(vocabulary, text):
    known = segmentations(vocabulary, f" {text}")
    encoder, decoder = sp.Encoder(vocabulary), sp.Decoder(vocabulary)
    for key in range(20):
        got = encoder([text], [key], 6)[0]
        ids = [tuple(i.tolist()) for i, _ in got]
        assert len(set(ids)) == len(ids) == min(6, len(known))
        assert all(abs(known[i] - s.log_prob) < 1e-9 for i, (_, s) in zip(ids, got, strict=True))
        keys = [s.perturbed for _, s in got]
        assert keys == sorted(keys, reverse=True) and all(s.log_inclusion <= 0 for _, s in got)
        assert all(decoder(i) == text for i in ids)
        assert [tuple(i.tolist()) for i, _ in sp.Encoder(vocabulary)([text], [key], 6)[0]] == ids


def test_frequencies_are_those_of_sampling_without_replacement(vocabulary):
    text = "then"
    known = segmentations(vocabulary, f" {text}")
    p = {k: math.exp(x) for k, x in known.items()}
    encoder, n = sp.Encoder(vocabulary), 6000
    first, pairs = Counter(), Counter()
    for key in range(n):
        ids = [tuple(i.tolist()) for i, _ in encoder([text], [key], 2)[0]]
        first[ids[0]] += 1
        pairs[tuple(ids)] += 1
    for a in known:
        assert abs(first[a] / n - p[a]) < 4 * math.sqrt(p[a] / n) + 1e-3
    for a, b in itertools.permutations(sorted(p, key=p.get)[-4:], 2):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - q) < 4 * math.sqrt(q / n) + 1e-3


def test_inclusion_scores_give_unbiased_sums(vocabulary):
    text = "other then"
    known = segmentations(vocabulary, f" {text}")
    encoder, n = sp.Encoder(vocabulary), 3000
    sums = [sum(math.exp(s.log_prob - s.log_inclusion) for _, s in encoder([text], [key], 3)[0]) for key in range(n)]
    assert len(known) > 20 and abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(n)


def test_long_words_match_short_ones(vocabulary):
    a, b = sp.Lattices(vocabulary), sp.Lattices(vocabulary)
    units = [" the", " thntst", "é", "\n", " 漢字\U0001f642", "x" * 40, "   a"]
    a.build(units)
    b._build_long(units)

    def edges(l, u):
        r = l.root[u]
        return {(k, int(l.piece[e]), round(float(l.logp[e]), 9), int(l.to[e]) - r if l.to[e] >= 0 else -1) for k in range(len(u)) for e in range(l.first[r + k], l.first[r + k + 1])}

    assert all(edges(a, u) == edges(b, u) for u in units)


def test_encode_and_decode_rows(spark, vocabulary):
    data = [(1, "Hello  world\n a\tb ßñ é 漢字 \U0001f642 ▁x"), (2, None), (3, ""), (None, "a"), (None, "a"), (4, "y" * 20_000), (5, " lead and trail ")]
    df = sp.encode(docs(spark, data).repartition(3), round_trip=True)
    got = df.collect()
    assert all(r.round_trip for r in got)
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 1, 3: 1, None: 4, 4: 3, 5: 3}
    assert all(r.log_inclusion == 0 for r in got if r.doc_id in (2, 3, None))
    text = dict(data)
    back = sp.decode(df.where("doc_id is not null")).select("doc_id", "text").collect()
    assert all(r.text == (text[r.doc_id] or "") for r in back)
    again = sp.encode(docs(spark, data[:1] + data[-1:])).collect()
    assert {(r.doc_id, r.sample, tuple(r.pieces)) for r in again} == {(r.doc_id, r.sample, tuple(r.pieces)) for r in got if r.doc_id in (1, 5)}
    assert sp.encode(docs(spark, [])).count() == 0
    assert sp.decode(df.limit(1).withColumn("pieces", F.lit(None).cast("array<int>"))).first().text is None
    assert sp.decode(sp.decode(df.where("doc_id = 5"))).columns[-1] == "text"


def test_samples_do_not_depend_on_batches(vocabulary):
    texts = ["the cat sat", "on \u6f22 the mat", "y" * 300, "", "and thn wrote it then", "a"] + [f"word{i} then other" for i in range(30)]
    keys = list(range(len(texts)))
    got = lambda ts, ks: [[(tuple(p.tolist()), s.log_prob, s.perturbed, s.log_inclusion) for p, s in found] for found in sp.Encoder(vocabulary)(ts, ks, 3)]
    whole = got(texts, keys)
    assert whole == [got([t], [k])[0] for t, k in zip(texts, keys, strict=True)]
    assert whole[::-1] == got(texts[::-1], keys[::-1])


def test_trimmed_lattices_give_the_same_samples(monkeypatch, vocabulary):
    texts = [f"the same words {n} again, and {n * n} new ones\nπ☃ {'long' * 13}{n}" for n in range(40)]

    def sampled(kept):
        monkeypatch.setattr(sp, "KEPT_EDGES", kept)
        encoder, out = sp.Encoder(vocabulary), []
        for n, t in enumerate(texts):
            out += [(p.tolist(), s.log_prob, s.perturbed, s.log_inclusion) for p, s in encoder([t], [n], 3)[0]]
        return out, encoder.lattices.nodes

    whole, most = sampled(10**9)
    for kept in (0, 400, 1500):
        some, nodes = sampled(kept)
        assert some == whole
        assert nodes < most


def test_decoding_gathers_the_bytes_of_any_pieces(vocabulary):
    decoder, table = sp.Decoder(vocabulary), [p.encode() for p in vocabulary.pieces]
    for b, i in enumerate(vocabulary.bytes):
        table[i] = bytes([b])
    plain = lambda ids: b"".join(table[i] for i in ids).decode("utf-8", "replace")[1:]
    rng = np.random.default_rng(3)
    spelt = [vocabulary.ids[" "], *(vocabulary.bytes[b] for b in "漢".encode())]
    runs = [[], [vocabulary.ids[" "]], spelt, spelt[1:], spelt[:3], spelt[2:], *(rng.integers(0, len(table), n).tolist() for n in (1, 5, 400))]
    good = [[vocabulary.ids[" the"]], [], spelt, [vocabulary.ids[" "]]]
    for some in (runs, good, [[]], *([x] for x in runs), [spelt[:3], spelt[3:]]):
        got = decoder.texts(np.array(list(itertools.chain.from_iterable(some)), np.int64), np.array([len(x) for x in some]))
        assert got.to_pylist() == [plain(x) for x in some]
