"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded and verified.

Weights. A text's five-word shingles weigh (times it occurs) * idf, where idf is
1 + ln(1 + N / max(df, COMMON * N)) / ln(1 + 1 / COMMON), at most 2. The leading 1
keeps the words that a large group of copies shares from counting for next to nothing:
with the logarithm alone, one other word in 200 takes two copies out of a group of all
rows below SIMILARITY. Document counts df are exact for every shingle in at least COMMON of all N documents
and can't matter below, so the table of df has at most (mean shingles a document) / COMMON
rows whatever the size of the corpus. It is found in two scans: a shingle of that
frequency has half of it in tasks in which it has half of it, so tasks report what
reaches COMMON / 2 of their rows; what sums to COMMON / 2 of N is then counted exactly.

Samples. Improved consistent weighted sampling draws, for each shingle, two gamma
variables and a uniform one from the shingle's hash, quantises the weight and takes
the least value. One evaluation of each occurrence of a shingle serves all samples: its
hash also deals it to one of BINS bins, each bin gives a sample, and empty bins borrow
from others by a fixed sequence of hashes. Bins count alike; as each occurrence is dealt
by itself and weighs 1 to 2, a shingle of many occurrences has its share of all bins.

Links. Samples are banded. In each bucket, texts are compared with the bucket's
smallest and largest id. Buckets of more texts are narrowed by further samples, level
by level as in an LSH forest, and texts meet the smallest id of each narrower bucket.
So what leaders link is never expanded into all pairs. Between texts of buckets in which
several components are left, no link is lost: an exact prefix join finds all pairs of
them across components. Shingles have one order, rarest first by a table of SLOTS counters
of their hashes (only the cost depends on it). Two texts of similarity SIMILARITY share one in
the first 1 - SIMILARITY of either's weight, with no more weight before it than their union
has beside their overlap. Pairs of one shingle are compared in blocks of BLOCK rows, so no task
holds more, and by sketches, sums of weights by hash, whose least values bound the overlap
from above. A link is a weighted Jaccard similarity of at least
SIMILARITY computed from both whole texts. Classes are connected components.

Defined cases: null text is empty; equal texts are always one class, empty texts
too; a text of one to four words has one shingle of all its words; white space
isn't compared but by equality; very long texts are compared whole; rows that repeat an id
are one text, the longest of them (of equally long ones the last by content), and share
its class; rows with a null id have class null and stay; an empty table gives an empty
result; other columns are ignored by classes and kept as they are by near_keep,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualweave.llm import words
from qualweave.llm.graphs import components, free, joined, one_text_each, sized
from qualweave.session import cut

SIMILARITY = 0.8
COMMON = 0.01
BINS, ROWS_A_BAND = 128, 5
BANDS = BINS // ROWS_A_BAND
#: Samples beyond a band's own that narrow crowded buckets, level by level.
NARROWER = (3, 6, 9, 13, 17)
#: A bucket of so many texts is settled by its two leaders.
SETTLED = 3
#: Pairs across components verified in one round for each text of the corpus: a round's disk grows with the corpus, the number of rounds doesn't; they go on until all are.
PAIRS_A_TEXT = 3
#: Partners of one leader that one task compares.
PARTNERS = 1_000
#: Slots that count shingles, for their order; cells of a sketch; rows of one shingle that one task compares with each other.
SLOTS, CELLS, BLOCK = 1 << 20, 256, 2_000
#: Room for rounding in bounds.
SLACK = 1e-6
U = np.uint64
_KEYS = [U(0x243F6A8885A308D3 + 0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in range(8)]
_AGAIN = U(0xA24BAED4963EE407)


def smoothed(ratio):
    """The idf of a shingle that one in ratio documents has."""
    return 1 + np.log1p(ratio) / np.log1p(1 / COMMON)


class Weights:
    """1 + ln(1 + N / df) / ln(1 + 1 / COMMON) with df from a bounded table, at least COMMON * N."""

    def __init__(self, n: int, table: dict[int, int]) -> None:
        order = np.array(sorted(table), np.int64)
        self.hashes = order
        floor = max(COMMON * n, 1e-9)
        self.idf = smoothed(n / np.maximum([table[int(h)] for h in order] or np.zeros(0), floor))
        self.rare = float(smoothed(n / max(floor, 1.0)))

    def __call__(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return tf * self.rare
        key = s.view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
        return tf * np.where(self.hashes[at] == key, self.idf[at], self.rare)


def bags(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first text, number of texts, distinct shingles, their text, their counts; a run of texts at a time."""
    for first, run in words.chunks(texts):
        h, _, _, offsets = words.word_hashes(run)
        s, owner = words.shingles(h, offsets)
        yield first, len(run), *words.counted(s, owner)


def common_shingles(docs: DataFrame, text_col: str, n: int) -> dict[int, int]:
    """df of every shingle in at least COMMON of the n rows of docs (and of some others)."""

    def reported(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = [], 0
        held = 0
        for pdf in source:
            rows += len(pdf)
            for _, _, s, _, _ in bags(pdf[text_col]):
                seen.append(s)
                held += len(s)
            if held > 4_000_000:  # a report each so many shingles bounds the task's memory
                yield report(seen, rows)
                seen, rows, held = [], 0, 0
        if rows:
            yield report(seen, rows)

    def report(seen: list[np.ndarray], rows: int) -> pd.DataFrame:
        s, k = np.unique(np.concatenate(seen), return_counts=True)
        often = k >= COMMON / 2 * rows
        return pd.DataFrame({"s": s[often].view(np.int64), "k": k[often].astype(np.int64)})

    likely = docs.select(text_col).mapInPandas(reported, "s long, k long").groupBy("s").agg(F.sum("k").alias("k")).where(F.col("k") >= COMMON / 2 * n)
    candidates = np.sort(np.array([r.s for r in likely.select("s").collect()], np.int64))
    if not len(candidates):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def counted(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for pdf in source:
            for _, _, s, _, _ in bags(pdf[text_col]):
                key = s.view(np.int64)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                total += np.bincount(at[known[at] == key], minlength=len(known))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"s": known[some], "k": total[some]})

    exact = docs.select(text_col).mapInPandas(counted, "s long, k long").groupBy("s").agg(F.sum("k").alias("k"))
    return {r.s: r.k for r in exact.collect()}


def samples(s: np.ndarray, owner: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A (rows, BINS) matrix of samples, and which rows have any shingle."""
    u = [words.unit(words.mix(s ^ k)) for k in _KEYS[:5]]
    r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
    t = np.floor(np.log(weight) / r + beta)
    value = np.log(c) - r * (t - beta) - r
    cell = owner * BINS + (words.mix(s ^ _KEYS[5]) & U(BINS - 1)).astype(np.int64)
    least = np.full(rows * BINS, np.inf)
    np.minimum.at(least, cell, value)
    wins = value == least[cell]
    drawn = np.zeros(rows * BINS, U)
    drawn[cell[wins]] = words.mix(s[wins] ^ words.mix(t[wins].astype(np.int64).view(U) + _KEYS[6]))
    drawn, full = drawn.reshape(rows, BINS), np.isfinite(least).reshape(rows, BINS)
    some = full.any(axis=1)
    lack = np.flatnonzero(some & ~full.all(axis=1))
    if len(lack):
        part, own, bins = drawn[lack], full[lack], np.arange(BINS, dtype=U)
        got = own.copy()
        left = np.arange(len(lack))
        for attempt in range(1, 1 + 2 * BINS):
            # The last BINS attempts walk in a circle, so every bin finds a full one.
            to = (words.mix(bins * U(0x100000001B3) + U(attempt)) & U(BINS - 1)).astype(np.int64) if attempt <= BINS else (np.arange(BINS) + attempt - BINS) % BINS
            take = ~got[left] & own[left][:, to]
            part[left] = np.where(take, part[left][:, to] if attempt == 1 else drawn[lack[left]][:, to], part[left])
            got[left] |= take
            left = left[~got[left].all(axis=1)]
            if not len(left):
                break
        drawn[lack] = part
    return drawn, some


def signature(s: np.ndarray, owner: np.ndarray, tf: np.ndarray, rows: int, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """samples of texts with each occurrence of a shingle as an element of its own.

    Least and greatest weights of two texts add up over occurrences to those of the
    shingle, so similarities are the same, and no element weighs more than 2.
    """
    at = np.repeat(np.arange(len(s)), tf)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)
    element, again = s[at], np.flatnonzero(nth)
    element[again] = words.mix(element[again] ^ words.mix(nth[again].astype(U) * _AGAIN))
    return samples(element, owner[at], weights(s, np.ones(len(s)))[at], rows)


def band_hashes(drawn: np.ndarray, more: int = 0) -> np.ndarray:
    """A hash of each band's samples and of the more samples that follow them, in a circle."""
    acc = np.broadcast_to(np.arange(BANDS, dtype=U) + U(BANDS * more) + _KEYS[7], (len(drawn), BANDS)).copy()
    for k in range(ROWS_A_BAND + more):
        acc = words.mix(acc * U(0x9E3779B97F4A7C15) + drawn[:, (np.arange(BANDS) * ROWS_A_BAND + k) % (BANDS * ROWS_A_BAND)])
    return acc.view(np.int64)


def similarities(heads: list[str], of: np.ndarray, texts: list[str], weights: Weights) -> np.ndarray:
    """Similarity of each text and heads[of], from whole texts; 0.0 where neither has a shingle. of ascends by 0 or 1; a head is read once for many texts."""

    def weighed(some: list[str]):
        parts = [(s, owner + first, tf) for first, _, s, owner, tf in bags(some)]
        s, owner, tf = (np.concatenate([p[k] for p in parts]) for k in range(3))
        w = weights(s, tf)
        return s, owner, w, np.bincount(owner, w, len(some)), np.searchsorted(owner, np.arange(len(some) + 1))

    out = np.zeros(len(texts))
    step, i = 1 << 20, 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < step):
            size += len(texts[j]) + (len(heads[of[j]]) if j == i or of[j] != of[j - 1] else 0)
            j += 1
        own = of[i:j] - of[i]
        s1, _, w1, total1, at1 = weighed(heads[of[i] : of[j - 1] + 1])
        s2, o2, w2, total2, at2 = weighed(texts[i:j])
        shared = np.zeros(j - i)
        runs = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        for p, q in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            mine, theirs = slice(at1[own[p]], at1[own[p] + 1]), slice(at2[p], at2[q])
            known, s = s1[mine], s2[theirs]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            same = known[at] == s
            shared[p:q] = np.bincount(o2[theirs][same] - p, np.minimum(w1[mine][at[same]], w2[theirs][same]), q - p)
        total = total1[own] + total2
        out[i:j] = np.divide(shared, total - shared, out=np.zeros(j - i), where=total > 0)
        i = j
    return out


def _verified(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """The pairs (a, b) whose texts are similar. pairs are distinct, a < b; texts: id, text.

    Of a pair, the text of more pairs leads. Its text goes once to each task that compares
    it with others, in front of theirs, and not once with each of them; a leader of many pairs is
    dealt to a task for each PARTNERS of them.
    """
    degrees = sized(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))))
    of = lambda c: degrees.select(F.col("id").alias(c), F.col("degree").alias(f"d{c}"))
    first = F.col("da") >= F.col("db")
    parts = F.ceil(F.greatest("da", "db") / PARTNERS)
    led = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), parts.alias("parts"))
    led = cut(led.select("lead", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id"))
    some = texts.join(degrees.select("id"), "id")
    heads = led.select("lead", "part", F.col("lead").alias("id")).distinct().join(some, "id").withColumn("follows", F.lit(False))
    rows = heads.unionByName(led.join(some, "id").withColumn("follows", F.lit(True)))
    ordered = rows.select("lead", "part", "follows", "id", "text").repartition("lead", "part").sortWithinPartitions("lead", "part", "follows", "id")

    def similar(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, held = Weights(*shared.value), None
        for pdf in source:
            whole = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            head = ~whole["follows"].to_numpy(bool)
            held = whole[head].iloc[-1:]
            rest = np.flatnonzero(~head)
            ok = similarities(whole["text"][head].tolist(), (np.cumsum(head) - 1)[rest], whole["text"].iloc[rest].tolist(), weights) >= SIMILARITY
            lead, other = (whole[c].to_numpy()[rest[ok]] for c in ("lead", "id"))
            yield pd.DataFrame({"a": np.minimum(lead, other), "b": np.maximum(lead, other)})

    return ordered.mapInPandas(similar, "a long, b long")


def _with_leaders(entries: DataFrame) -> DataFrame:
    """entries (rep, weight, key, ...) of buckets with several texts, with the bucket's smallest and largest id and its size."""
    leader = F.struct("rep", "weight")
    buckets = entries.groupBy("key").agg(F.min(leader).alias("low"), F.max(leader).alias("high"), F.count("*").alias("n")).where("low.rep < high.rep")
    return entries.join(buckets, "key")


def _meetings(crowded: DataFrame, leader: str) -> DataFrame:
    """Pairs of a bucket's texts and its leader, but for those whose weights alone keep them under SIMILARITY."""
    of, weight = F.col(f"{leader}.rep"), F.col(f"{leader}.weight")
    alike = F.least("weight", weight) >= SIMILARITY * (1 - 1e-9) * F.greatest("weight", weight)
    return crowded.where((F.col("rep") != of) & alike).select(F.least("rep", of).alias("a"), F.greatest("rep", of).alias("b")).distinct()


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of texts (id, text) fall on each of SLOTS slots."""

    def counted(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for pdf in source:
            for _, _, s, _, _ in bags(pdf["text"]):
                np.add.at(total, _slots(s), 1)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "k": total[some]})

    found = texts.select("text").mapInPandas(counted, "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["k"].to_numpy()
    return out


def prefixes(s: np.ndarray, owner: np.ndarray, w: np.ndarray, rows: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, text, and weight before it, of the rarest shingles of each text: the first 1 - SIMILARITY of its weight."""
    order = np.lexsort((s, counts[_slots(s)], owner))
    s, owner, w = s[order], owner[order], w[order]
    total, upto = np.bincount(owner, w, rows), np.cumsum(w) - w
    before = upto - upto[np.searchsorted(owner, np.arange(rows))[owner]]
    begun = before <= (1 - SIMILARITY + SLACK) * total[owner]
    return s[begun], owner[begun], before[begun]


def sketches(s: np.ndarray, owner: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """A (rows, CELLS) matrix of the weight of each text's shingles by hash, in units of the text's weight / 2 ** 15, rounded up."""
    cell = owner * CELLS + (words.mix(s ^ _KEYS[7]) & U(CELLS - 1)).astype(np.int64)
    held = np.bincount(cell, w, rows * CELLS).reshape(rows, CELLS)
    return np.ceil(held * (2.0**15 / np.maximum(held.sum(axis=1, keepdims=True), 1e-9))).astype(np.uint16)


def _possible(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of texts of different components, rows of one key and pair of blocks, that can be as alike as SIMILARITY.

    Rows (key, one, two, side, rep, label, weight, before, sketch) come in order. Those of
    one block are compared if it is paired with itself, else those of one with those of the other.
    """
    held = None
    for pdf in source:
        whole = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        groups = np.stack([whole[c].to_numpy() for c in ("key", "one", "two")])
        tail = len(whole) - int((groups != groups[:, -1:]).any(axis=0)[::-1].argmax()) if (groups != groups[:, -1:]).any() else 0
        held = whole.iloc[tail:]
        if tail:
            yield _compared(whole.iloc[:tail], groups[:, :tail])
    if held is not None and len(held):
        yield _compared(held, np.stack([held[c].to_numpy() for c in ("key", "one", "two")]))


def _compared(pdf: pd.DataFrame, groups: np.ndarray) -> pd.DataFrame:
    rep, label, side, weight, before = (pdf[c].to_numpy() for c in ("rep", "label", "side", "weight", "before"))
    n = len(rep)
    by = np.where(groups[1] == groups[2], label, side)
    new = np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(axis=0)])
    runs = np.flatnonzero(new | np.concatenate([[True], by[1:] != by[:-1]]))
    # Each row meets those of its group from the next run on.
    at = np.repeat(np.append(runs[1:], n), np.diff(np.append(runs, n)))
    starts = np.flatnonzero(new)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    row = np.flatnonzero(at < end)
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(n, CELLS)
    found = [np.zeros((2, 0), np.int64)]
    at, end = at[row], end[row]
    while len(row):
        step = max(1, 2_000_000 // len(row))
        span = np.minimum(end - at, step)
        a = np.repeat(row, span)
        b = np.repeat(at, span) + np.arange(len(a)) - np.repeat(np.cumsum(span) - span, span)
        both = weight[a] + weight[b]
        # The overlap that a pair of that similarity has, and the most that is left from here on.
        least = np.maximum(SIMILARITY / (1 + SIMILARITY) * both, SIMILARITY * np.maximum(weight[a], weight[b]))
        can = (label[a] != label[b]) & (np.minimum(weight[a] - before[a], weight[b] - before[b]) >= least - SLACK * both)
        a, b, least, both = a[can], b[can], least[can], both[can]
        for k in range(0, len(a), 20_000):
            i, j = a[k : k + 20_000], b[k : k + 20_000]
            most = np.minimum(sketch[i] * (weight[i] / 2.0**15).astype(np.float32)[:, None], sketch[j] * (weight[j] / 2.0**15).astype(np.float32)[:, None]).sum(axis=1, dtype=np.float64)
            close = most >= least[k : k + 20_000] - SLACK * both[k : k + 20_000]
            found.append(np.stack([rep[i[close]], rep[j[close]]]))
        at = at + span
        row, at, end = (v[at < end] for v in (row, at, end))
    pairs = np.concatenate(found, axis=1)
    pairs = np.unique(np.stack([pairs.min(axis=0), pairs.max(axis=0)]), axis=1)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _rest(texts: DataFrame, labels: DataFrame, shared) -> DataFrame:
    """All pairs (a, b) of texts (id, text) of different components that can be as alike as SIMILARITY; no pair that is gets lost."""
    counts = texts.sparkSession.sparkContext.broadcast(_slot_counts(texts))

    def begun(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = Weights(*shared.value)
        for pdf in source:
            out, ids = [], pdf["id"].to_numpy()
            for first, rows, s, owner, tf in bags(pdf["text"]):
                w = weights(s, tf)
                total, cells = np.bincount(owner, w, rows), sketches(s, owner, w, rows)
                keys, own, before = prefixes(s, owner, w, rows, counts.value)
                edge = np.searchsorted(own, np.arange(rows + 1))
                for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    out.append((ids[first + i], total[i], cells[i].tobytes(), keys[a:b].view(np.int64), before[a:b]))
            yield pd.DataFrame(out, columns=["rep", "weight", "sketch", "keys", "befores"])

    entries = texts.mapInPandas(begun, "rep long, weight double, sketch binary, keys array<long>, befores array<double>")
    entries = cut(entries.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    keys = entries.select("rep", "label", F.explode("keys").alias("key"))
    # Keys of one component have nothing to compare. Rows of others are dealt in blocks; a component of many has blocks of its own, which needn't meet.
    several = cut(keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    each = entries.select("rep", "label", "weight", "sketch", F.explode(F.arrays_zip("keys", "befores")).alias("e")).select("rep", "label", "weight", "sketch", F.col("e.keys").alias("key"), F.col("e.befores").alias("before"))
    each = each.join(several, "key")
    alone = each.where(F.col("n") <= BLOCK).withColumns({"one": F.lit(0), "two": F.lit(0), "side": F.lit(0)})
    crowded = several.where(F.col("n") > BLOCK).select("key")
    if not crowded.isEmpty():
        held = keys.join(crowded, "key").groupBy("key", "label").agg(F.count("*").alias("m"))
        held = held.withColumn("own", F.when(F.col("m") > BLOCK, F.col("label")))
        parts = held.groupBy("key", "own").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("parts"))
        blocks = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = cut(blocks.withColumn("block", F.row_number().over(Window.partitionBy("key").orderBy("own", "part"))))
        x, y = (blocks.select("key", F.col("own").alias(f"own{c}"), F.col("block").alias(c)) for c in ("one", "two"))
        pairs = x.join(y, "key").where("one <= two and not coalesce(ownone = owntwo, false)").select("key", "one", "two")
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
        dealt = each.drop("n").join(cut(held), ["key", "label"]).withColumnRenamed("own", "of")
        dealt = dealt.join(blocks.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("of").eqNullSafe(F.col("own")) & (F.pmod(F.xxhash64("rep"), F.col("parts")) == F.col("part")))
        dealt = dealt.select("key", "rep", "label", "weight", "sketch", "before", "block").join(sides, ["key", "block"]).withColumn("side", F.col("block"))
        alone = alone.select(*_ROW).unionByName(dealt.select(*_ROW))
    by = F.when(F.col("one") == F.col("two"), F.col("label")).otherwise(F.col("side"))
    ordered = alone.select(*_ROW).repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", by, "rep")
    return ordered.mapInPandas(_possible, "a long, b long").distinct()


_ROW = ["key", "one", "two", "side", "rep", "label", "weight", "before", "sketch"]


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one component yet."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of the class), class_size, kept (id is class_id)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    present = base.where(F.col("id").isNotNull())
    known = one_text_each(present, "id")
    n = known.count()
    shared = docs.sparkSession.sparkContext.broadcast((n, common_shingles(known, "text", n)))

    def signed(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = Weights(*shared.value)
        for pdf in source:
            bands, weight = [], [np.zeros(0)]
            for _, rows, s, owner, tf in bags(pdf["text"]):
                weight.append(np.bincount(owner, weights(s, tf), rows))
                drawn, some = signature(s, owner, tf, rows, weights)
                h = band_hashes(drawn)
                bands += [h[i] if some[i] else [] for i in range(rows)]
            yield pd.DataFrame({"id": pdf["id"], "sha": pdf["sha"], "weight": np.concatenate(weight), "bands": bands})

    signatures = cut(known.withColumn("sha", F.unhex(F.sha2("text", 256))).mapInPandas(signed, "id long, sha binary, weight double, bands array<long>"))
    owners = cut(signatures.groupBy("sha").agg(F.min("id").alias("rep")))
    entries = signatures.join(owners, (signatures.sha == owners.sha) & (signatures.id == owners.rep)).select("rep", "weight", F.explode("bands").alias("key")).distinct()
    crowded = cut(_with_leaders(entries))
    pairs = _meetings(crowded, "low").union(_meetings(crowded, "high"))

    # Texts of buckets that two leaders don't settle meet leaders of ever narrower buckets too.
    def narrowed(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = Weights(*shared.value)
        for pdf in source:
            keys, weight = [], [np.zeros(0)]
            for _, rows, s, owner, tf in bags(pdf["text"]):
                weight.append(np.bincount(owner, weights(s, tf), rows))
                drawn, _ = signature(s, owner, tf, rows, weights)
                keys += np.concatenate([band_hashes(drawn, m) for m in NARROWER], axis=1).tolist()
            yield pd.DataFrame({"rep": pdf["id"], "weight": np.concatenate(weight), "keys": keys})

    unsettled = cut(crowded.where(F.col("n") > SETTLED).select(F.col("rep").alias("id")).distinct())
    finer = known.join(sized(unsettled), "id").mapInPandas(narrowed, "rep long, weight double, keys array<long>")
    narrow = cut(_with_leaders(finer.select("rep", "weight", F.posexplode("keys").alias("place", "key"))))
    pairs = cut(pairs.union(_meetings(narrow, "low")).distinct())
    labels = components(cut(_verified(pairs, known, shared)))
    # Texts of buckets in which several components are left are compared across them, all that can be similar.
    crowd = crowded.where(F.col("n") > SETTLED).select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = cut(crowd.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one < two").select("key"))
    open_ = cut(crowd.join(several, "key", "left_semi").select(F.col("rep").alias("id")).distinct())
    if not open_.isEmpty():
        found = cut(_rest(known.join(sized(open_), "id", "left_semi"), labels, shared).join(pairs, ["a", "b"], "left_anti"))
        rounds = int(np.ceil(found.count() / (PAIRS_A_TEXT * n)))
        for k in range(rounds):
            now = found.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
            labels = joined(labels, cut(_verified(cut(_apart(now, labels) if k else now), known, shared)))
    classes = owners.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sha", F.coalesce("label", "rep").alias("class_id"))
    placed = cut(signatures.select("id", "sha").join(classes, "sha").select("id", "class_id"))
    if n < present.count():
        placed = present.select("id").join(placed, "id")
    # Classes of one row need no size; the others are few or are joined by a shuffle that splits a large class.
    sizes = sized(cut(placed.groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1")))
    grouped = placed.join(sizes, "class_id", "left").select("id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"))
    lost = base.where(F.col("id").isNull()).select("id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(lost).withColumnRenamed("id", id_col)


def near_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, without those whose class has a smaller id."""
    (name,) = free(docs, "near_dropped")
    dropped = cut(near_classes(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(name)).distinct())
    return docs.join(sized(dropped), F.col(id_col) == F.col(name), "left_anti")
