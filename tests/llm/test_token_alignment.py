"""Token alignment against a plain comparison of all tokens of a text."""

import hashlib
import sys
from collections import Counter

import numpy as np
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from qualweave.llm import token_alignment
from qualweave.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)


def plain_tokens(a, b, text):
    """(id, bytes) of both sides; nothing where they don't spell the text."""
    if not text:
        return [], []
    alphabet = token_alignment.byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain_counts(rows):
    a, b = tokenizers()
    linked, out = [], []
    for doc, text in rows:
        left, right = map(spans, plain_tokens(a, b, text))
        common = sorted({e for _, _, e in left} & {e for _, _, e in right})
        links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
        groups = []
        for start, end in zip([0, *common], common, strict=False):
            part = lambda side: ",".join(str(i) for i, _, e in side if start < e <= end)  # noqa: B023, E731
            groups.append(f"{part(left)}|{part(right)}")
        linked.append(links)
        out.append([doc, len(left), len(right), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""])
    counts = Counter(p for links in linked for p in links)
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return [(*row[:5], sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), row[5]) for row, links in zip(out, linked, strict=True)]


def answers(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


ODD = [
    (1, "The quick brown fox, don't stop."),
    (2, None),
    (3, ""),
    (4, "  two  spaces\n\n\tand   lines \r\n "),
    (5, "naïve Übergröße — 東京 🎉 ́"),
    (6, "<|endoftext|> <s> </s> <unk> <0x0A>"),
    (7, "a mark ▁ that B reads as a space"),
    (8, "\x00 control \x1f\x85"),
    (9, "x"),
    (9, "x"),
    (None, "no id"),
    (10, " "),
    (11, "﻿mark ​ zero ﷺ"),
]


def test_odd_texts(spark):
    got = answers(token_alignment.link_counts(docs(spark, ODD)))
    assert got == sorted(plain_counts(ODD), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[7][1:] == (0, 0, 0, 0, 0, 0, "") and by_id[6][1] > 10
    assert answers(token_alignment.link_counts(docs(spark, []))) == []
    assert answers(token_alignment.link_counts(docs(spark, [(1, None), (2, "▁")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_batches_and_partitions_change_nothing(spark):
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, f"line {i} repeats: the end, {'word ' * i}") for i in range(30)]
    wanted = sorted(plain_counts(rows), key=repr)
    for parts, chars in ((1, 10**6), (6, 40)):
        assert answers(token_alignment.link_counts(docs(spark, rows).repartition(parts), batch_chars=chars)) == wanted


def test_very_long_text_is_aligned_whole(spark):
    text = "Lorem ipsum, dolor sit amet 123 " * 20_000
    row = token_alignment.link_counts(docs(spark, [(1, text), (2, "short")])).where("doc_id = 1").first()
    pair = token_alignment.load()
    a, _, b, _ = pair.encode([text])
    assert (row["n_a"], row["n_b"]) == (len(a), len(b)) and row["n_groups"] > 100_000


def test_align_gives_groups_that_spell_the_same_bytes(spark):
    pair = token_alignment.load()
    for r in token_alignment.align(docs(spark, ODD)).collect():
        at_a = at_b = 0
        for a, b in zip(r["a_upto"], r["b_upto"], strict=True):
            left, right = (b"".join(t[i] for i in ids) for t, ids in ((pair.a_bytes, r["a_ids"][at_a:a]), (pair.b_bytes, r["b_ids"][at_b:b])))
            assert left == right != b""
            at_a, at_b = a, b
        assert (at_a, at_b) == (len(r["a_ids"]), len(r["b_ids"]))


def test_given_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 2500).select("doc_id", "text").collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 100
    assert answers(token_alignment.link_counts(table)) == sorted(plain_counts(rows), key=repr)


def test_query_reads_all_documents(spark, small):
    found = QUERIES["op12_token_alignment"](spark, small)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert found.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert found.where("n_links < greatest(n_a, n_b) or n_groups > least(n_a, n_b) or n_best > n_links").count() == 0


def test_both_libraries_encode_every_code_point_alike():
    a, _ = tokenizers()
    pair = token_alignment.load()
    texts = [f" a{c}b {c} 1{c}2  {c}{c} x" for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    for k in range(0, len(texts), 50_000):
        some = texts[k : k + 50_000]
        assert pair.a_encode(some) == [e.ids for e in a.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(0, 10**6), st.integers(-5, 70))
def test_gallop_finds_ranks_from_any_guess(steps, seed, guess):
    long = np.cumsum(steps)
    short = np.unique(np.random.default_rng(seed).integers(1, long[-1] + 1, 12))
    assert (token_alignment.gallop(short, long, np.full(len(short), guess)) == np.searchsorted(long, short)).all()
