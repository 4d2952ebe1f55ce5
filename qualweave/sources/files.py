"""Path discovery, and an optional reader of HDF5 files.

The Parquet layout of views.py is the native format. The HDF5 source needs h5py, which
isn't installed here; tests run it over a stand-in. A file is checked when a scan is
planned, before any task starts; ranges of reads are then read in parallel, as Arrow batches.
Conditions on file and read_id narrow the ranges (with spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from qualweave.constants import ALPHABET
from qualweave.errors import SequenceError
from qualweave.sources.manifest import BOUNDARY_CHECKS

PATTERN = "SRR*.h5"


def discover(paths: Iterable[str | Path]) -> list[Path]:
    """Files in the order given; a directory gives its own SRR*.h5 sorted; repeated paths count once."""
    found: dict[Path, None] = {}
    for path in map(Path, paths):
        if not path.exists():
            raise FileNotFoundError(path)
        for file in sorted(path.glob(PATTERN)) if path.is_dir() else [path]:
            found.setdefault(file.resolve())
    if not found:
        raise SequenceError("no HDF5 files found")
    return list(found)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


#: Names of the datasets that a file must have.
DATASETS = ("observed", "freqs", "read_offsets")
SCHEMAS = {
    "positions": "file string, read_id long, pos int, row_idx long, observed int, freqs array<float>",
    "reads": "file string, read_id long, length int",
    "boundaries": "file string, idx long, row long",
}
#: Boundaries checked, and rows sent, at once.
CHUNK = 1 << 16


def check(handle, path: str) -> int:
    """The number of reads of an open file; SequenceError if it breaks a rule of the layout. Boundaries pass in chunks."""
    missing = [n for n in DATASETS if n not in handle]
    if missing:
        raise SequenceError(f"{path}: lacks {', '.join(missing)}")
    observed, freqs, offsets = (handle[n] for n in DATASETS)
    if len(observed.shape) != 1 or len(freqs.shape) != 2 or len(offsets.shape) != 1:
        raise SequenceError(f"{path}: observed and read_offsets must have one dimension, freqs two")
    rows, n = observed.shape[0], offsets.shape[0]
    if freqs.shape[0] != rows:
        raise SequenceError(f"{path}: observed has {rows} rows, freqs {freqs.shape[0]}")
    if freqs.shape[1] != ALPHABET:
        raise SequenceError(f"{path}: freqs has {freqs.shape[1]} columns instead of {ALPHABET}")
    if n < 2:
        raise SequenceError(f"{path}: {BOUNDARY_CHECKS['too_few_boundaries']}")
    before = None
    for at in range(0, n, CHUNK):
        part = np.asarray(offsets[at : at + CHUNK], np.int64)
        if before is None and part[0] != 0:
            raise SequenceError(f"{path}: {BOUNDARY_CHECKS['first_boundary']}")
        # The edge of a chunk is carried to the next.
        if (np.diff(part, prepend=part[0] if before is None else before) < 0).any():
            raise SequenceError(f"{path}: {BOUNDARY_CHECKS['falling_boundaries']}")
        before = part[-1]
    if before != rows:
        raise SequenceError(f"{path}: {BOUNDARY_CHECKS['last_boundary']}")
    if rows == 0:
        raise SequenceError(f"{path}: all reads are empty")
    return n - 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table = options.get("table", "positions")
        self.paths = [str(p) for p in discover(options["path"].split(","))]
        self.reads_a_task = int(options.get("reads_a_task", 10_000))
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes files and ranges of reads; gives back what Spark must still test."""
        number = "idx" if self.table == "boundaries" else "read_id"
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "file" and isinstance(f, EqualTo):
                self.paths = [p for p in self.paths if p == f.value]
            elif name == "file" and isinstance(f, In):
                self.paths = [p for p in self.paths if p in f.value]
            elif name == number and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == number and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == number and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif not (name in ("file", number) and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[_Range]:
        import h5py

        out = []
        for path in self.paths:
            with h5py.File(path) as f:
                n = check(f, path)
            stop = min(self.high, n + (self.table == "boundaries"))
            out += [_Range(path, a, min(stop, a + self.reads_a_task)) for a in range(self.low, stop, self.reads_a_task)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        import h5py

        if part.start >= part.stop:
            return
        with h5py.File(part.path) as f:
            ids = np.arange(part.start, part.stop, dtype=np.int64)
            if self.table == "boundaries":
                yield self._batch(part.path, ids, np.asarray(f["read_offsets"][part.start : part.stop], np.int64))
                return
            offsets = np.asarray(f["read_offsets"][part.start : part.stop + 1], np.int64)
            length = np.diff(offsets)
            if self.table == "reads":
                yield self._batch(part.path, ids, length.astype(np.int32))
                return
            for a in range(int(offsets[0]), int(offsets[-1]), CHUNK):
                row = np.arange(a, min(int(offsets[-1]), a + CHUNK), dtype=np.int64)
                # The last read that begins at or before a row; empty reads that begin there too come before it.
                k = np.searchsorted(offsets, row, "right") - 1
                counts = np.asarray(f["freqs"][a : a + len(row)], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * ALPHABET), pa.array(counts.ravel()))
                yield self._batch(part.path, ids[k], (row - offsets[k]).astype(np.int32), row, np.asarray(f["observed"][a : a + len(row)]).astype(np.int32), lists)

    def _batch(self, path: str, *columns) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        file = pa.array([path] * len(columns[0]), pa.string())
        return pa.RecordBatch.from_arrays([file, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=names)


class Hdf5Source(DataSource):
    """spark.dataSource.register(Hdf5Source); spark.read.format("quality_h5").option("path", ...).option("table", "reads").load()

    table: positions (the default), reads, with the empty ones, or boundaries.
    """

    @classmethod
    def name(cls) -> str:
        return "quality_h5"

    def schema(self) -> str:
        table = self.options.get("table", "positions")
        if table not in SCHEMAS:
            raise SequenceError(f"unknown table: {table}")
        return SCHEMAS[table]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
