"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content, and buckets that don't
fit the memory given to a table are dealt again by further bits, level by level,
until each fits. Spark's shuffle files are the spill files. Each bucket streams
through an open-addressing table that compares complete contents.

Before the shuffle the same table runs on each input partition, so a text with
any number of copies leaves a task at most once per filled table, and a hot group
never meets in one task as whole rows.

Defined cases: null text counts as empty; empty texts are copies of each other;
rows that repeat an id are copies like any others and share the outcome of that
id; a null id is smaller than any other; a text longer than a table has one of its
own and is compared whole; an empty table gives an empty result; other columns are
ignored by exact_classes and kept as they are by exact_keep, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualweave.llm.graphs import free

TABLE_BYTES = 64 << 20
FIRST_BITS, MORE_BITS, LEVELS = 12, 6, 8
LISTED_BUCKETS = 10_000
#: What a held row is taken to need besides its text.
ROW_BYTES = 200


class ContentTable:
    """Open addressing with linear probing; equal means equal bytes, not equal hashes."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.ranks: list[int] = []
        self.rows: list[int] = []
        self.bytes = 0

    def _place(self, h: int) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 2, -1, np.int64)
        for i, h in enumerate(self.hashes):
            self.slots[self._place(h)] = i

    def add(self, h: int, content: bytes, rank: int, rows: int) -> tuple[int, bool]:
        """The entry of this content, and whether rank is its largest so far."""
        mask = len(self.slots) - 1
        at = h & mask
        while (i := int(self.slots[at])) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                self.rows[i] += rows
                if rank > self.ranks[i]:
                    self.ranks[i] = rank
                    return i, True
                return i, False
            at = (at + 1) & mask
        i = len(self.hashes)
        self.slots[at] = i
        self.hashes.append(h)
        self.contents.append(content)
        self.ranks.append(rank)
        self.rows.append(rows)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return i, True


def _hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=7).digest(), "little")


class _Held:
    """The winning row of each entry. Rows come together in copies of their own; a copy that is half replaced is made anew."""

    def __init__(self) -> None:
        self.place: dict[int, tuple[int, int]] = {}  # entry: chunk, bytes
        self.chunks: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        self.live: dict[int, int] = {}
        self.full: dict[int, int] = {}
        self.next = self.bytes = 0

    def put(self, source: pa.RecordBatch, rows: dict[int, int], size: dict[int, int]) -> None:
        """rows: the place of each entry's new row in source."""
        for chunk in {self._drop(e) for e in rows if e in self.place}:
            if not self.live[chunk]:
                self._forget(chunk)
            elif self.live[chunk] < self.full[chunk] / 2:
                batch, entries = self._forget(chunk)
                left = {e: k for k, e in enumerate(entries) if self.place.get(e, (None,))[0] == chunk}
                self._keep(batch, left, {e: self.place[e][1] for e in left})
        self._keep(source, rows, size)

    def _drop(self, entry: int) -> int:
        chunk, size = self.place.pop(entry)
        self.live[chunk] -= size
        return chunk

    def _forget(self, chunk: int) -> tuple[pa.RecordBatch, list[int]]:
        self.bytes -= self.full.pop(chunk)
        del self.live[chunk]
        return self.chunks.pop(chunk)

    def _keep(self, source: pa.RecordBatch, rows: dict[int, int], size: dict[int, int]) -> None:
        chunk, self.next = self.next, self.next + 1
        self.chunks[chunk] = source.take(pa.array(list(rows.values()), pa.int64())), list(rows)
        self.live[chunk] = self.full[chunk] = sum(size.values())
        self.bytes += self.full[chunk]
        for e in rows:
            self.place[e] = chunk, size[e]

    def batches(self) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        """All held rows, and their entries."""
        for chunk, (batch, entries) in self.chunks.items():
            at = [k for k, e in enumerate(entries) if self.place.get(e, (None,))[0] == chunk]
            if at:
                yield batch.take(pa.array(at, pa.int64())), [entries[k] for k in at]


class _Reducer:
    """Streams Arrow batches through tables; yields the winning row of each content."""

    def __init__(self, text: str, names: list[str], limit: int, counted: bool) -> None:
        self.text, self.limit, self.counted = text, limit, counted
        self.leaf, self.rank, self.rows = names

    def _drain(self, table: ContentTable, held: _Held) -> Iterator[pa.RecordBatch]:
        for batch, entries in held.batches():
            yield batch.set_column(batch.schema.get_field_index(self.rows), self.rows, pa.array([table.rows[e] for e in entries], pa.int64()))

    def __call__(self, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, leaf = ContentTable(), _Held(), None
        for whole in source:
            names = whole.schema.names
            leaves = whole.column(names.index(self.leaf)).to_pylist()
            start = 0
            while start < len(leaves):
                stop = start + 1
                while stop < len(leaves) and (not self.counted or leaves[stop] == leaves[start]):
                    stop += 1
                if (self.counted and leaves[start] != leaf) or (not self.counted and held.bytes > self.limit):
                    yield from self._drain(table, held)
                    table, held = ContentTable(), _Held()
                leaf = leaves[start]
                part = whole.slice(start, stop - start)
                texts = part.column(names.index(self.text)).to_pylist()
                ranks = part.column(names.index(self.rank)).to_pylist()
                counts = part.column(names.index(self.rows)).to_pylist()
                winners = {}
                for i, t in enumerate(texts):
                    content = (t or "").encode("utf-8", "surrogatepass")
                    entry, wins = table.add(_hash(content), content, ranks[i] if ranks[i] is not None else -(1 << 63), counts[i])
                    if wins:
                        winners[entry] = i
                if winners:
                    held.put(part, winners, {e: len(table.contents[e]) + ROW_BYTES for e in winners})
                start = stop
        yield from self._drain(table, held)


def _leaves(docs: DataFrame, text: str, table_bytes: int):
    """An expression for each row's bucket: a hash prefix, longer where the bucket's distinct contents outgrow a table."""
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1)
    sizes = docs.select(h.alias("h"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("n")).groupBy("h").agg(F.max("n").alias("n"))

    def prefix(bits: int):
        return lambda c: F.concat(F.lit(f"{bits}:"), F.shiftright(c, 63 - bits).cast("string"))

    bits, finest = FIRST_BITS, prefix(FIRST_BITS)
    rule = finest
    left = sizes
    for _ in range(LEVELS):
        over = left.groupBy(finest(F.col("h")).alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).where((F.col("n") > table_bytes) & (F.col("k") > 1))
        names = [r.leaf for r in over.select("leaf").limit(LISTED_BUCKETS + 1).collect()]
        if not names:
            break
        bits += MORE_BITS
        coarse, was, finest = rule, finest, prefix(bits)
        if len(names) > LISTED_BUCKETS:
            rule, left = finest, sizes
        else:
            rule = lambda c, was=was, finest=finest, coarse=coarse, names=names: F.when(was(c).isin(names), finest(c)).otherwise(coarse(c))
            left = left.where(was(F.col("h")).isin(names))
    return rule(h)


def _winners(docs: DataFrame, id_col: str, text_col: str, table_bytes: int) -> tuple[DataFrame, str]:
    """One row of docs for each distinct content, that of the largest id, and the name of a column that counts its rows."""
    names = leaf, rank, rows = free(docs, "grace_leaf", "grace_rank", "grace_rows")
    marked = docs.withColumns({leaf: _leaves(docs, text_col, table_bytes), rank: F.col(id_col).cast("long"), rows: F.lit(1).cast("long")})
    local = marked.mapInArrow(_Reducer(text_col, names, table_bytes, False), marked.schema)
    dealt = local.repartition(F.col(leaf)).sortWithinPartitions(leaf)
    return dealt.mapInArrow(_Reducer(text_col, names, table_bytes, True), marked.schema), rows


def exact_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Rows of docs, all columns, of which each content has one: the row with the largest id."""
    return _winners(docs, id_col, text_col, table_bytes)[0].select(*docs.columns)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The tables decide by whole contents; SHA-256 only carries their decision back
    to the rows, so that no list of a group's members is ever built.
    """
    docs = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    winners, rows = _winners(docs, id_col, text_col, table_bytes)
    classes = winners.select(F.sha2(F.col(text_col), 256).alias("text_sha256"), F.col(id_col).alias("keep_id"), F.col(rows).alias("group_size"))
    return (
        docs.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("text_sha256"))
        .join(classes, "text_sha256")
        .select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
