"""Alignment of two tokenizers' tokens of the same text by the bytes that they cover.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece
BPE with byte fallback (B, which adds the space itself). A token ends at a byte offset; both
lists of ends rise. Galloping intersection: the shorter list of a document drives; each of its
ends gallops from its expected place in the longer list, in steps that double until they
straddle it, and a binary search settles its rank there. Ends that both lists have cut
the text into groups, and the ranks of a token's start and end give the tokens of the other
side that overlap it: links are the rank differences, never found by comparing tokens pairwise.
All ends of a batch gallop together.

Counts. How often an id pair is linked in the corpus: each batch of texts has its distinct
pairs counted, Spark sums them, finds the highest count of each B id, and sends a batch the
sums of its own pairs. A pair comes once from each batch, so no pair is hot; nothing is
broadcast. Links themselves stay with their batch.

Defined cases: a text that is null, empty or doesn't come back from its tokens, byte by byte,
has no tokens, zeros and an empty digest; rows that repeat an id each get their own result, and
their links count for each; a very long text is a batch of its own and is aligned whole; null
ids are carried along; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.session import saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts that are aligned together; a longer text is aligned alone.
BATCH_CHARS = 3_000_000
PAIR_BASE = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level entries: printable Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how a byte-level BPE splits text before it merges.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Both tokenizers and the bytes of all their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_bpe)
        a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        alphabet = byte_alphabet()
        entries = a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            plain = all(c in alphabet for c in entry)
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if plain else entry.encode()
        with open(byte_bpe, encoding="utf-8") as f:
            model = json.load(f)
        split = model.get("pre_tokenizer") or {}
        by_bytes = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("normalizer")
        ordered = by_bytes and self._merges_follow_ids(model["model"])
        if ordered:
            # The same merges in the same order, by a library that is four times faster.
            import tiktoken

            ranks = {self.a_bytes[i]: i for i in model["model"]["vocab"].values() if i not in {t["id"] for t in model.get("added_tokens", ())}}
            plain = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.a_encode = lambda texts: [plain.encode_ordinary(t) for t in texts]
        else:
            self.a_encode = lambda texts: [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])) for t in (self.a_bytes, self.b_bytes)]

    @staticmethod
    def _merges_follow_ids(model: dict) -> bool:
        vocab = model["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        return model.get("type") == "BPE" and not model.get("ignore_merges") and made == sorted(made)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, first of each text; ids of B, first of each text (firsts have one more than texts); none where bytes differ."""
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        a, a_first, a_same = self._flat(0, self.a_encode(spaced), raw)
        b, b_first, b_same = self._flat(1, self.b.encode(texts, num_threads=1), raw)
        same = a_same & b_same
        if not same.all():
            (a, a_first), (b, b_first) = ((ids[np.repeat(same, np.diff(f))], np.concatenate([[0], np.cumsum(np.where(same, np.diff(f), 0))])) for ids, f in ((a, a_first), (b, b_first)))
        return a, a_first, b, b_first

    def _flat(self, side: int, ids: list[list[int]], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the first of each text, and whether its tokens' bytes are raw."""
        letters, first = self.tables[side]
        tokens = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(tokens[-1]))
        size = first[flat + 1] - first[flat]
        upto = np.concatenate([[0], np.cumsum(size)])
        length, wanted = np.diff(upto[tokens]), np.array([len(r) for r in raw], np.int64)
        good = length == wanted
        got = letters[np.arange(upto[-1]) + np.repeat(first[flat] - upto[:-1], size)]
        want = np.frombuffer(b"".join(raw), np.uint8)
        if not good.all():
            got, want = got[np.repeat(good, length)], want[np.repeat(good, wanted)]
        owner = np.repeat(np.flatnonzero(good), length[good])
        good[owner[got != want]] = False
        return flat, tokens, good


@functools.lru_cache(maxsize=2)
def load(byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Pair:
    return Pair(byte_bpe, piece_bpe)


def encoded(pair: Pair, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair.encode, with no tokens for null and empty texts."""
    there = np.array([bool(t) for t in texts], bool)
    a, a_first, b, b_first = pair.encode([t for t in texts if t])
    spread = lambda first: first[np.concatenate([[0], np.cumsum(there)])]
    return a, spread(a_first), b, spread(b_first)


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """How many of long are under each of short: steps from the guess double until they straddle it, then the interval is halved."""
    n = len(long)
    lo, hi = np.full(len(short), -1), np.full(len(short), n)  # long[lo] < short <= long[hi]
    at, step = np.clip(guess, 0, n - 1), 1
    lanes = np.arange(len(short))
    upward = long[at] < short
    while len(lanes):
        under = long[at] < short[lanes]
        lo[lanes[under]] = at[under]
        hi[lanes[~under]] = at[~under]
        on = under == upward
        lanes, upward = lanes[on], upward[on]
        at = at[on] + np.where(upward, step, -step)
        inside = (at >= 0) & (at < n)
        lanes, upward, at = lanes[inside], upward[inside], at[inside]
        step *= 2
    lanes = np.flatnonzero(hi - lo > 1)
    while len(lanes):
        middle = (lo[lanes] + hi[lanes]) >> 1
        under = long[middle] < short[lanes]
        lo[lanes[under]] = middle[under]
        hi[lanes[~under]] = middle[~under]
        lanes = lanes[hi[lanes] - lo[lanes] > 1]
    return hi


def linked(short: np.ndarray, s_first: np.ndarray, long: np.ndarray, l_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends (places in both lists) and links (places in both) of documents that follow each other.

    short and long are rising end offsets over all documents; the last of each document is common.
    """
    none = np.zeros(0, np.int64)
    if not len(short):
        return none, none, none, none
    n_s, n_l = np.diff(s_first), np.diff(l_first)
    along = np.arange(len(short)) - np.repeat(s_first[:-1], n_s)
    guess = np.repeat(l_first[:-1], n_s) + along * np.repeat(n_l, n_s) // np.maximum(1, np.repeat(n_s, n_s))
    rank = gallop(short, long, guess)
    common = long[rank] == short
    # The tokens that overlap go from the one after the last that ended by the start, to the one that holds the end.
    first = np.concatenate([[0], (rank + common)[:-1]])
    size = rank - first + 1
    upto = np.cumsum(size)
    own = np.repeat(np.arange(len(short)), size)
    other = np.arange(upto[-1]) + np.repeat(first - (upto - size), size)
    return np.flatnonzero(common), rank[common], own, other


class Aligned:
    """Tokens of a batch of texts, their common ends and links."""

    def __init__(self, pair: Pair, texts: list[str | None]) -> None:
        self.a, self.a_first, self.b, self.b_first = encoded(pair, texts)
        n_a, n_b = np.diff(self.a_first), np.diff(self.b_first)
        a_size, b_size = (np.array([len(t) for t in table], np.int64) for table in (pair.a_bytes, pair.b_bytes))
        a_end, b_end = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        cuts_a, cuts_b, links_a, links_b = [], [], [], []
        for a_drives in (True, False):
            docs = (n_a <= n_b) == a_drives
            at_a, at_b = np.flatnonzero(np.repeat(docs, n_a)), np.flatnonzero(np.repeat(docs, n_b))
            first_a, first_b = (np.concatenate([[0], np.cumsum(n[docs])]) for n in (n_a, n_b))
            if a_drives:
                ca, cb, la, lb = linked(a_end[at_a], first_a, b_end[at_b], first_b)
            else:
                cb, ca, lb, la = linked(b_end[at_b], first_b, a_end[at_a], first_a)
            cuts_a.append(at_a[ca])
            cuts_b.append(at_b[cb])
            links_a.append(at_a[la])
            links_b.append(at_b[lb])
        self.cut_a, self.cut_b = np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))
        la, lb = np.concatenate(links_a), np.concatenate(links_b)
        doc = np.searchsorted(self.a_first, la, "right") - 1
        order = np.argsort(doc, kind="stable")
        self.link_a, self.link_b = la[order], lb[order]
        self.link_first = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        self.group_first = np.searchsorted(self.cut_a, self.a_first)

    def digests(self, tables: tuple[list[str], int, int]) -> list[str]:
        """sha256 of the groups' decimal ids of each text; empty without tokens."""
        words, a_span, b_span = tables
        is_a, is_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        is_a[self.cut_a] = 1
        is_b[self.cut_b] = 1
        last = self.b_first[1:][np.diff(self.b_first) > 0] - 1
        is_b[last] = 2
        # Tokens in the order of the text: of each group those of A, then those of B.
        group_a, group_b = np.cumsum(is_a) - is_a, np.cumsum(is_b > 0) - (is_b > 0)
        ended_b = np.concatenate([[0], self.cut_b + 1])
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + ended_b[group_a]] = self.a + is_a * a_span
        order[np.arange(len(self.b)) + (self.cut_a + 1)[group_b]] = 2 * a_span + self.b + is_b * b_span
        first = self.a_first + self.b_first
        return [hashlib.sha256("".join([words[w] for w in order[s:e].tolist()]).encode()).hexdigest() if e > s else "" for s, e in zip(first[:-1], first[1:], strict=True)]


def digest_words(pair: Pair) -> tuple[list[str], int, int]:
    """Decimal ids with what follows them: of A a comma or bar, of B a comma, semicolon or nothing."""
    a, b = [str(i) for i in range(len(pair.a_bytes))], [str(i) for i in range(len(pair.b_bytes))]
    return [w + end for part, ends in ((a, ",|"), (b, [",", ";", ""])) for end in ends for w in part], len(a), len(b)


def _batches(source: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[list, list[str | None]]]:
    ids, texts, held = [], [], 0
    for pdf in source:
        for i, text in zip(pdf["id"].to_list(), pdf["text"].to_list(), strict=True):
            size = len(text) if text else 0
            if texts and held + size > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(None if pd.isna(i) else int(i))
            texts.append(text if isinstance(text, str) else None)
            held += size
    if texts:
        yield ids, texts


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, a_ids, b_ids, and for each group how many tokens of each side there are up to its end."""

    def work(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(byte_bpe, piece_bpe)
        for ids, texts in _batches(source, batch_chars):
            t = Aligned(pair, texts)
            rows = []
            for i, doc in enumerate(ids):
                a, b, g = (slice(f[i], f[i + 1]) for f in (t.a_first, t.b_first, t.group_first))
                rows.append((doc, t.a[a], t.b[b], t.cut_a[g] + 1 - a.start, t.cut_b[g] + 1 - b.start))
            yield pd.DataFrame(rows, columns=["doc_id", "a_ids", "b_ids", "a_upto", "b_upto"]).astype({"doc_id": "Int64"})

    return _base(docs, id_col, text_col).mapInPandas(work, "doc_id long, a_ids array<int>, b_ids array<int>, a_upto array<int>, b_upto array<int>")


_TOKENS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
_NAMES = [c.split()[0] for c in _TOKENS.split(", ")]


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Sizes and digest of each document's alignment, with corpus-wide counts of its links: n_best, count_sum."""

    def work(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pair = load(byte_bpe, piece_bpe)
        tables, batch = digest_words(pair), TaskContext.get().partitionId() << 32
        for ids, texts in _batches(source, batch_chars):
            t = Aligned(pair, texts)
            pairs, place, counts = np.unique(t.b[t.link_b] * PAIR_BASE + t.a[t.link_a], return_inverse=True, return_counts=True)
            place, n = place.astype(np.int32), [np.diff(f) for f in (t.a_first, t.b_first, t.group_first, t.link_first)]
            rows = [(batch, doc, *(int(f[i]) for f in n), sha, place[t.link_first[i] : t.link_first[i + 1]].tobytes(), None, None) for i, (doc, sha) in enumerate(zip(ids, t.digests(tables), strict=True))]
            rows.append((batch, None, 0, 0, 0, 0, None, None, pairs, counts))
            yield pd.DataFrame(rows, columns=_NAMES).astype({"doc_id": "Int64"})
            batch += 1

    tokens = saved(_base(docs, id_col, text_col).mapInPandas(work, _TOKENS))
    pairs = tokens.where(F.col("pairs").isNotNull()).select("batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = saved(pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("pair", 32)))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "b").select("pair", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"))
    known = pairs.select("batch", "place", "pair").join(counts, "pair").select("batch", "place", "total", "best")
    known = known.toDF(*known.columns)  # columns of its own, as both sides come from tokens

    def finish(docs_: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        total, best = np.zeros(len(stats), np.int64), np.zeros(len(stats), np.int64)
        total[stats["place"]], best[stats["place"]] = stats["total"], stats["best"]
        places = [np.frombuffer(raw, np.int32) for raw in docs_["links"]]
        out = docs_.drop(columns=["batch", "links"])
        out["n_best"], out["count_sum"] = [int(best[p].sum()) for p in places], [int(total[p].sum()) for p in places]
        return out

    rows = tokens.where(F.col("pairs").isNull()).drop("pairs", "counts")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(finish, out).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
