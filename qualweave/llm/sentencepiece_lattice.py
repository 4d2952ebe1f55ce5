"""SentencePiece encoding by sampling distinct segmentations, and decoding.

All segmentations of a text into pieces form a lattice. A sample without replacement
of K of them is the K best after adding Gumbel noise to every log-probability. The
noise is never drawn for each segmentation: a perturbed A* search starts from the
root, whose best perturbed value is a Gumbel variable, and splits sets of
segmentations into the branch taken and the branches left, whose best values are
Gumbel variables truncated at the value of the set. Backward sums make the mass of
every set exact, so the search goes straight to its answers: a text of n pieces
costs K * n steps. The search leaves the next best value, KAPPA, from which the
inclusion score of a sample is log(1 - exp(-exp(log_prob - KAPPA))).

Pieces never cross the start of a word, so a lattice is a chain of small lattices,
one per word, and distinct words are built once.

Models of rank-scored pieces (BPE) have no probabilities; a piece of rank r then
weighs 1 / (r + 2.7), as word frequencies do. A character without a piece is spelt
in byte pieces. Random numbers are hashes of the row's key and of the place that they
are drawn for, and all sums stay within a text or a node; nothing depends on
partitions or batches. Texts of a batch walk together.

Defined cases: null text is empty; an empty text has one segmentation, without
pieces; a text with fewer than K segmentations gives all it has, with inclusion
score 0 (certain) for each; rows that repeat a key and text give equal samples; a
null key is a key like any other; a text is encoded whole, however long; an empty
table gives an empty result; other columns are ignored, whatever their names. Decoding
returns the very text; null pieces decode to null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from qualweave.llm import words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
SEED = 20_240_601
#: Edges of words kept built between texts, by each task: 24 bytes each, up to twice that while arrays grow.
#: Beyond that, words that were met in one batch only are forgotten.
KEPT_EDGES = 2_000_000
#: Texts of so many characters together are encoded at once; a longer one is encoded alone. Arrays of more would go back to the system at each step (see ensure_workers).
BATCH_CHARS = 80_000
#: Longer words are built character by character.
LONG_WORD = 48
UNIT = re.compile(r" *[^ \t\n\x0b\x0c]+| +|[\t\n\x0b\x0c]")
U = np.uint64
PIECE_BASE = U(0x9FB21C651E98DF25)
SPREAD = U(0x9E3779B97F4A7C15)
#: Beginnings of pieces are looked up by so many leading bits of their spread hashes.
LEAD = 18


@dataclass
class Vocabulary:
    """Pieces as plain text (a space for the space mark), their log-probabilities, and the ids of the 256 byte pieces."""

    pieces: list[str]
    ids: dict[str, int]
    logp: list[float]
    bytes: list[int]
    longest: int
    by_word: bool

    def __post_init__(self) -> None:
        self.spelt = min(self.logp)
        self.logps = np.array(self.logp)
        # Hashes of all beginnings of pieces, with the piece that a beginning is, or -1.
        table: dict[int, tuple[str, int]] = {}
        for p, i in self.ids.items():
            h = 0
            for k, c in enumerate(p, 1):
                h = (h * int(PIECE_BASE) + ord(c) + 1) & (1 << 64) - 1
                known, value = table.setdefault(h, (p[:k], -1))
                if known != p[:k]:
                    raise ValueError("two beginnings of pieces have the same hash")
                if k == len(p):
                    table[h] = (known, i)
        keys = np.array(list(table), U)
        spread = keys * SPREAD
        order = np.argsort(spread)
        self.keys = np.append(spread[order], U(0))
        self.key_ids = np.array([table[h][1] for h in keys[order].tolist()] + [-1], np.int64)
        self.leads = np.searchsorted(spread[order], np.arange(1 << LEAD, dtype=U) << U(64 - LEAD))
        self.leads = np.append(self.leads, len(keys))

    def begins(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are those of beginnings of pieces, and the pieces that those are, or -1."""
        spread = h * SPREAD
        lead = (spread >> U(64 - LEAD)).astype(np.int64)
        at, stop = self.leads[lead], self.leads[lead + 1]
        rest = np.flatnonzero(at < stop)
        found = np.zeros(len(h), bool)
        while len(rest):
            same = self.keys[at[rest]] == spread[rest]
            found[rest[same]] = True
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        return found, self.key_ids[at[found]]


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    pieces, ids, byte_ids = [], {}, [0] * 256
    for i in range(n):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            ids.setdefault(p.replace("▁", " "), i)
        pieces.append(p.replace("▁", " "))
    order = sorted(ids.values(), key=lambda i: (-m.get_score(i), i))
    logp = [0.0] * n
    total = math.log(sum(1 / (r + 2.7) for r in range(len(order))))
    for r, i in enumerate(order):
        logp[i] = -math.log(r + 2.7) - total
    by_word = not any(len(p) > 1 and re.search(r"[^ ] |[\t\n\x0b\x0c]", p) for p in ids)
    return Vocabulary(pieces, ids, logp, byte_ids, max(map(len, ids)), by_word)


def _rest(log_prob: np.ndarray) -> np.ndarray:
    """Log of what an edge's siblings have of its node's mass; -inf for an only edge."""
    with np.errstate(divide="ignore"):
        return np.where(log_prob < 0, np.log(-np.expm1(np.minimum(log_prob, -1e-300))), -np.inf)


class Lattices:
    """Lattices of distinct words in flat arrays: nodes with their edges and cumulative probabilities; the order of a node's edges follows from its word."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.root: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(1024, np.int64)
        self.cum = np.zeros(4096)
        self.logp = np.zeros(4096)
        self.to = np.zeros(4096, np.int32)
        self.piece = np.zeros(4096, np.int32)
        self.again = np.zeros(1024, bool)

    def roots(self, units: list[str]) -> np.ndarray:
        """Start nodes of words; those that aren't there yet are built."""
        out = np.fromiter(map(self.root.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(out < 0)
        self._room("again", self.nodes + 1)[out[out >= 0]] = True
        if len(missing):
            fresh = [units[i] for i in missing.tolist()]
            self.build(list(dict.fromkeys(fresh)))
            out[missing] = np.fromiter(map(self.root.__getitem__, fresh), np.int64, len(fresh))
            self._room("again", self.nodes + 1)
        return out

    def trim(self) -> None:
        """Keeps the words met again since the last trim, as they are built; none, if they are many."""
        old = [(x, r) for x, r in self.root.items() if self.again[r]]
        base = np.array([r for _, r in old], np.int64)
        size = np.array([len(x) for x, _ in old], np.int64)
        edges = self.first[base + size] - self.first[base] if old else base
        if not old or int(edges.sum()) > KEPT_EDGES // 2:
            self.reset()
            return
        nodes = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        count = self.first[nodes + 1] - self.first[nodes]
        first = np.cumsum(count) - count
        at = np.repeat(self.first[nodes] - first, count) + np.arange(int(count.sum()))
        moved = np.cumsum(size) - size
        shift = np.repeat(moved - base, edges)
        cum, logp, to, piece = self.cum[at], self.logp[at], self.to[at], self.piece[at]
        self.reset()
        self.nodes, self.edges = len(nodes), len(at)
        self.first = np.append(first, len(at))
        self.cum, self.logp, self.piece = cum, logp, piece
        self.to = np.where(to >= 0, to + shift, -1).astype(np.int32)
        self.again = np.zeros(self.nodes + 1, bool)
        self.root = dict(zip([x for x, _ in old], moved.tolist(), strict=True))

    def _room(self, name: str, need: int) -> np.ndarray:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
            return new
        return old

    def build(self, units: list[str]) -> None:
        """Adds words that aren't there yet, all at once but for long ones."""
        long = [x for x in units if len(x) > LONG_WORD]
        short = [x for x in units if len(x) <= LONG_WORD]
        if short:
            self._build_short(short)
        if long:
            self._build_long(long)

    def _build_short(self, units: list[str]) -> None:
        v = self.v
        size = np.array([len(x) for x in units])
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        n, base = len(code), np.cumsum(size) - size
        end = np.repeat(base + size, size)
        left = end - np.arange(n)
        # Pieces at each character: beginnings are followed while some piece has them.
        at, h = np.arange(n), np.zeros(n, U)
        froms, tos, ids = [], [], []
        for k in range(v.longest):
            if k:
                more = left[at] > k
                at, h = at[more], h[more]
            if not len(at):
                break
            h = h * PIECE_BASE + code[at + k] + U(1)
            begins, piece = v.begins(h)
            at, h = at[begins], h[begins]
            whole = piece >= 0
            froms.append(at[whole])
            tos.append(at[whole] + k + 1)
            ids.append(piece[whole])
            if not k:
                bare = np.ones(n, bool)
                bare[froms[0]] = False
                bare = np.flatnonzero(bare)
        froms.append(bare)
        tos.append(bare + 1)
        ids.append(len(v.pieces) + code[bare].astype(np.int64))
        source, to, piece = (np.concatenate(x) for x in (froms, tos, ids))
        weight = np.empty(len(piece))
        spelt = len(piece) - len(bare)
        weight[:spelt] = v.logps[piece[:spelt]]
        c = code[bare]
        weight[spelt:] = v.spelt * (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
        # Backward sums, the last characters of all words first; edges of a character are together, long ones first.
        span = LONG_WORD + 1  # of left and of to - source
        order = np.argsort((left[source] * (n + 1) + source) * span + span - 1 - (to - source))
        source, to, piece, weight = source[order], to[order], piece[order], weight[order]
        inside = to < end[source]
        beta = np.zeros(n + 1)
        start = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
        depth = left[source[start]]
        steps = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        count = np.diff(np.concatenate([start, [len(source)]]))
        w = np.empty(len(source))
        for d in range(len(steps) - 1):
            p, q = int(steps[d]), int(steps[d + 1])
            if p == q:
                continue
            a, b = int(start[p]), int(start[q]) if q < len(start) else len(source)
            x = weight[a:b] + np.where(inside[a:b], beta[to[a:b]], 0.0)
            own = start[p:q] - a
            top = np.maximum.reduceat(x, own)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[p:q])), own))
            beta[source[start[p:q]]] = total
            w[a:b] = x - np.repeat(total, count[p:q])
        # By character; the edges of one stay together.
        own = source[start]
        size_of = np.empty(n, np.int64)
        size_of[own] = count
        count = size_of
        ends = np.cumsum(count)
        shift = (ends - count)[own] - start
        order = np.empty(len(source), np.int64)
        order[np.arange(len(source)) + np.repeat(shift, count[own])] = np.arange(len(source))
        start = ends - count
        to, piece, w, inside = to[order], piece[order], w[order], inside[order]
        only = start[count == 1]
        w[only] = 0.0
        # Summed within each node, so that no bit depends on the other words.
        cum = np.exp(w)
        for k in range(1, int(count.max())):
            at = start[count > k] + k
            cum[at] += cum[at - 1]
        cum[start + count - 1] = 2.0
        nodes, total = self.nodes + n, self.edges + len(source)
        self._room("first", nodes + 1)[self.nodes : nodes] = self.edges + start
        self.first[nodes] = total
        for name, values in (("cum", cum), ("logp", w), ("to", np.where(inside, to + self.nodes, -1)), ("piece", piece)):
            self._room(name, total)[self.edges : total] = values
        self.root.update(zip(units, (self.nodes + base).tolist(), strict=True))
        self.nodes, self.edges = nodes, total

    def _build_long(self, units: list[str]) -> None:
        """The same for long words, one by one."""
        v, ids, logp, longest, spelt = self.v, self.v.ids, self.v.logp, self.v.longest, self.v.spelt
        first, cum, lps, to, piece = [], [], [], [], []
        nodes, edges = self.nodes, self.edges
        for x in units:
            n, base = len(x), nodes
            self.root[x] = base
            beta = [0.0] * (n + 1)
            built: list[list[tuple[float, int, int]]] = []
            for at in range(n - 1, -1, -1):
                out = []
                for end in range(at + 1, min(n, at + longest) + 1):
                    i = ids.get(x[at:end])
                    if i is not None:
                        out.append((logp[i] + beta[end], end, i))
                    elif end == at + 1:
                        out.append((spelt * len(x[at].encode("utf-8", "surrogatepass")) + beta[end], end, len(v.pieces) + ord(x[at])))
                out.sort(key=lambda o: (-o[0], o[1]))
                top = out[0][0]
                beta[at] = top + math.log(sum(math.exp(o[0] - top) for o in out)) if len(out) > 1 else top
                built.append(out)
            for at in range(n):
                first.append(edges)
                so_far, b = 0.0, beta[at]
                out = built[n - 1 - at]
                for w, end, i in out:
                    p = math.exp(w - b)
                    so_far += p
                    cum.append(so_far)
                    lps.append(w - b if len(out) > 1 else 0.0)
                    to.append(base + end if end < n else -1)
                    piece.append(i)
                cum[-1] = 2.0
                edges += len(out)
            nodes += n
        if nodes > self.nodes:
            self._room("first", nodes + 1)[self.nodes : nodes] = first
            self.first[nodes] = edges
            for name, values in (("cum", cum), ("logp", lps), ("to", to), ("piece", piece)):
                self._room(name, edges)[self.edges : edges] = values
            self.nodes, self.edges = nodes, edges

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one random path through each lattice from its start node (-1: nothing left), and how many each has.

        The steps of a lattice draw the numbers that its own seed gives, whatever is walked beside it.
        """
        n = len(start)
        active = np.flatnonzero(start >= 0)
        node, own, taken, step = start[active], seed[active], [], 0
        first, cum, to = self.first, self.cum, self.to
        counts = np.zeros(n, np.int64)
        while len(active) > 12:
            u = words.unit(words.mix(own + U(step)))
            e = first[node]
            wait = np.flatnonzero(u > cum[e])
            while len(wait):
                e[wait] += 1
                wait = wait[u[wait] > cum[e[wait]]]
            taken.append((active, e))
            counts[active] += 1
            node = to[e]
            alive = np.flatnonzero(node >= 0)
            active, node, own, step = active[alive], node[alive], own[alive], step + 1
        tails = []
        for a, at, s in zip(active.tolist(), node.tolist(), own, strict=True):
            out: list[int] = []
            while at >= 0:
                k = step + len(out)
                for u in words.unit(words.mix(s + np.arange(k, k + (8 if len(out) < 64 else 4096), dtype=U))).tolist():
                    e = int(first[at])
                    while u > cum[e]:
                        e += 1
                    out.append(e)
                    at = int(to[e])
                    if at < 0:
                        break
            tails.append((a, out))
            counts[a] += len(out)
        offset = np.cumsum(counts) - counts
        path = np.empty(int(counts.sum()), np.int64)
        for s, (a, e) in enumerate(taken):
            path[offset[a] + s] = e
        for a, out in tails:
            path[offset[a] + step : offset[a] + step + len(out)] = out
        return path, counts


@dataclass
class Sample:
    """edges and the word of each; before: log-mass in front of each level; left: best perturbed value of what its level leaves."""

    edges: np.ndarray
    word: np.ndarray
    log_prob: float
    perturbed: float
    before: np.ndarray
    left: np.ndarray
    log_inclusion: float = 0.0


def _truncated(mass: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log masses, each at most top."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(mass - top) - np.log(u)))


#: Streams of random numbers of one key: walks, levels, and single draws of each sample.
WALK, LEVEL, SINGLE = 0, 1, 2


def _stream(key: np.ndarray, kind: int, sample: int) -> np.ndarray:
    return words.mix(key + U((SEED + 3 * sample + kind) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def top_k(lattices: Lattices, texts: list[np.ndarray], keys: np.ndarray, k: int) -> list[list[Sample]]:
    """Of each text (roots of its words, one at least), the k best segmentations under Gumbel noise, best first; fewer if there are no more.

    All texts take each step together. A random number is a hash of the text's key,
    the sample, and the place that it is drawn for.
    """
    out: list[list[Sample]] = [[] for _ in texts]
    used: list[dict[tuple[int, int], list[int]]] = [{} for _ in texts]

    def walked(some: list[int], starts: list[np.ndarray], froms: list[int], sample: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Edges of a path through the last words of some texts, from word froms on, and the word of each edge."""
        n = np.array([len(s) for s in starts])
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n - froms, n)
        seed = words.mix(np.repeat(_stream(keys[some], WALK, sample), n) ^ words.mix(place.astype(U)))
        path, counts = lattices.walk(np.concatenate(starts), seed)
        word = np.repeat(place, counts)
        cuts = np.cumsum(np.add.reduceat(counts, ends - n))[:-1]
        return np.split(path, cuts), np.split(word, cuts)

    def admit(some: list[int], edges: list[np.ndarray], word: list[np.ndarray], values: list[float], since: list[int], sample: int) -> None:
        """Adds a sample to some texts; levels before since belong to its parent."""
        lps = [lattices.logp[e] for e in edges]
        uptos = [np.cumsum(lp) for lp in lps]
        befores = [upto - lp for upto, lp in zip(uptos, lps, strict=True)]
        n = np.array([len(e) - s for e, s in zip(edges, since, strict=True)])
        mass = np.concatenate([b[s:] for b, s in zip(befores, since, strict=True)]) + _rest(np.concatenate([lp[s:] for lp, s in zip(lps, since, strict=True)]))
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        u = words.unit(words.mix(np.repeat(_stream(keys[some], LEVEL, sample), n) + place.astype(U)))
        fresh = np.split(_truncated(mass, np.repeat(np.array(values), n), u), ends[:-1])
        for t, e, w, upto, before, s, value, own in zip(some, edges, word, uptos, befores, since, values, fresh, strict=True):
            left = np.full(len(e), -np.inf)
            left[s:] = own
            out[t].append(Sample(e, w, float(upto[-1]), value, before, left))

    everyone = list(range(len(texts)))
    if not everyone:
        return out
    root = -np.log(-np.log(words.unit(words.mix(_stream(keys, SINGLE, 0)))))
    edges, word = walked(everyone, texts, [0] * len(texts), 0)
    admit(everyone, edges, word, root.tolist(), [0] * len(texts), 0)
    tops = [[float(found[0].left.max())] for found in out]
    for sample in range(1, k):
        draw = [words.unit(words.mix(_stream(keys, SINGLE, sample) + U(i))) for i in (1, 2)]
        some, starts, froms, heads, values = [], [], [], [], []
        for t in everyone:
            top = max(tops[t])
            if top == -math.inf:
                continue
            j = tops[t].index(top)
            parent = out[t][j]
            at = int(parent.left.argmax())
            gone = used[t].setdefault((j, at), [int(parent.edges[at])])
            # Edges of a node are stored together; find the node's run.
            node = int(np.searchsorted(lattices.first[: lattices.nodes], gone[0], "right")) - 1
            options = [e for e in range(int(lattices.first[node]), int(lattices.first[node + 1])) if e not in gone]
            p = [math.exp(x) for x in lattices.logp[options].tolist()]
            goal, i = float(draw[0][t]) * math.fsum(p), 0
            while i < len(p) - 1 and goal > p[i]:
                goal, i = goal - p[i], i + 1
            gone.append(options[i])
            others = math.fsum(p[:i] + p[i + 1 :])
            mass = np.array([parent.before[at] + math.log(others) if others > 0 else -math.inf])
            parent.left[at] = _truncated(mass, top, draw[1][t : t + 1])[0]
            tops[t][j] = float(parent.left.max())
            w = int(parent.word[at])
            start = texts[t][w:].copy()
            start[0] = lattices.to[options[i]]
            some.append(t)
            starts.append(start)
            froms.append(w)
            heads.append((parent, at, options[i]))
            values.append(top)
        if not some:
            break
        tails, tail_words = walked(some, starts, froms, sample)
        edges = [np.concatenate([parent.edges[:at], [pick], tail]) for (parent, at, pick), tail in zip(heads, tails, strict=True)]
        word = [np.concatenate([parent.word[: at + 1], tail]) for (parent, at, _), tail in zip(heads, tail_words, strict=True)]
        admit(some, edges, word, values, [at + 1 for _, at, _ in heads], sample)
        for t in some:
            tops[t].append(float(out[t][-1].left.max()))
    for found, left in zip(out, tops, strict=True):
        kappa = max(left)
        for s in found:
            over = s.log_prob - kappa
            s.log_inclusion = 0.0 if kappa == -math.inf else (over if over < -30 else math.log(-math.expm1(-math.exp(min(over, 700.0)))))
    return out


class Encoder:
    """Encodes runs of texts; words stay built from one run of a task to the next."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.lattices = vocabulary, Lattices(vocabulary)
        self.bytes = np.array(vocabulary.bytes, np.int32)

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of edges, and how many each edge has: one, or those of the bytes of a spelt character."""
        out = self.lattices.piece[edges]
        count = np.ones(len(out), np.int64)
        spelt = np.flatnonzero(out >= len(self.v.pieces))
        if not len(spelt):
            return out, count
        each = [chr(c).encode("utf-8", "surrogatepass") for c in (out[spelt] - len(self.v.pieces)).tolist()]
        count[spelt] = [len(b) for b in each]
        whole = np.repeat(out, count)
        first = (np.cumsum(count) - count)[spelt]
        n = count[spelt]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        whole[np.repeat(first, n) + place] = self.bytes[np.frombuffer(b"".join(each), np.uint8)]
        return whole, count

    def __call__(self, texts: list[str | None], keys: list[int], k: int) -> list[list[tuple[np.ndarray, Sample]]]:
        """The samples of each text, best first, with their piece ids."""
        if self.lattices.edges > KEPT_EDGES:
            self.lattices.trim()
        units = [(UNIT.findall(f" {t}") if self.v.by_word else [f" {t}"]) if t else [] for t in texts]
        full = [i for i, own in enumerate(units) if own]
        cuts = np.cumsum([len(units[i]) for i in full])
        roots = np.split(self.lattices.roots(list(chain.from_iterable(units))), cuts[:-1]) if full else []
        found = top_k(self.lattices, roots, np.array([keys[i] & (1 << 64) - 1 for i in full], U), k)
        every = [s for samples in found for s in samples]
        ids, count = self.ids(np.concatenate([s.edges for s in every])) if every else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.cumsum([len(s.edges) for s in every])
        pieces = iter(np.split(ids, np.concatenate([[0], np.cumsum(count)])[ends[:-1]]) if every else [])
        nothing = np.zeros(0, np.int64)
        out: list[list[tuple[np.ndarray, Sample]]] = [[(nothing.astype(np.int32), Sample(nothing, nothing, 0.0, 0.0, nothing, nothing))] for _ in texts]
        for i, samples in zip(full, found, strict=True):
            out[i] = [(next(pieces), s) for s in samples]
        return out


class Decoder:
    """Texts of piece ids: the bytes of all pieces of a batch are gathered at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table = [p.encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.bytes):
            table[i] = bytes([b])
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table])
        self.start = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """A text for each run of ids of these lengths, without its first character, the space in front of the text."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(size.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        full = bounds[1:] > bounds[:-1]
        first = bounds[:-1][full]
        keep = np.ones(len(data), bool)
        keep[first] = False
        rest = bounds - np.concatenate([[0], np.cumsum(full)])
        body = data[keep]
        heads = body[rest[:-1][rest[1:] > rest[:-1]]]
        try:
            body.tobytes().decode("utf-8")
            whole = not (data[first] >= 0x80).any() and not ((heads & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:  # pieces that encode() didn't make: no space in front, or bytes that are no text
            raw = data.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.large_string())
        return pa.LargeStringArray.from_buffers(len(rest) - 1, pa.py_buffer(rest.astype(np.int64)), pa.py_buffer(body))

    def __call__(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.texts(ids, np.array([len(ids)]))[0].as_py()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model: str = MODEL, round_trip: bool = False) -> DataFrame:
    """Up to samples rows per row of docs: id, sample (from 1), pieces, n_pieces, log_prob, perturbed, log_inclusion.

    The vocabulary is read on the driver and shared (its size is the model's). round_trip
    adds a column of that name: whether decoding the pieces gave the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    names = [id_col, "sample", "pieces", "n_pieces", "log_prob", "perturbed", "log_inclusion"]

    def rows(encoder: Encoder, decoder: Decoder, ids: pa.Array, texts: list[str | None], keys: list[int]) -> pa.RecordBatch:
        of, pieces, out = [], [], []
        for i, (text, found) in enumerate(zip(texts, encoder(texts, keys, samples), strict=True)):
            for j, (p, s) in enumerate(found, 1):
                of.append(i)
                pieces.append(p)
                out.append((j, s.log_prob, s.perturbed, s.log_inclusion))
        lengths, every, of = np.array([len(p) for p in pieces]), np.concatenate(pieces), pa.array(of)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(every, pa.int32()))
        sample, *numbers = zip(*out, strict=True)
        columns = [ids.take(of), pa.array(sample, pa.int32()), lists, pa.array(lengths, pa.int32()), *(pa.array(c, pa.float64()) for c in numbers)]
        if round_trip:
            columns.append(pc.equal(decoder.texts(every, lengths), pa.array([t or "" for t in texts], pa.large_string()).take(of)))
        return pa.RecordBatch.from_arrays(columns, names=[*names, *(["round_trip"] if round_trip else [])])

    def sampled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in source:
            texts, keys, start = batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= BATCH_CHARS):
                    chars, stop = chars + len(texts[stop] or ""), stop + 1
                yield rows(encoder, decoder, batch.column(0).slice(start, stop - start), texts[start:stop], keys[start:stop])
                start = stop

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sample int, pieces array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double"
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(id_col))).mapInArrow(sampled, f"{schema}, round_trip boolean" if round_trip else schema)


def decode(encoded: DataFrame, pieces_col: str = "pieces", name: str = "text", model: str = MODEL) -> DataFrame:
    """encoded and the text of its pieces, in place of a column of that name."""
    encoded = encoded.drop(name)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def texts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in source:
            lists = batch.column(batch.schema.get_field_index(pieces_col))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            column = pc.if_else(lists.is_valid(), decoder.texts(ids, lengths), pa.scalar(None, pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return encoded.mapInArrow(texts, StructType([*encoded.schema.fields, StructField(name, StringType())]))
