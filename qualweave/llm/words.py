"""Stable vectorised hashing of words and word shingles (NumPy, no Spark).

Words are runs of bytes other than ASCII white space. Hashes don't depend on the
process, the batch or the machine, so any partitioning gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5
CHUNK_BYTES = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles strictly inside (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of about limit bytes; a longer text is a run of its own."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield at, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end (within the joined run) of each word, and offsets of words by text."""
    joined = b" ".join(run) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(b) + 1 for b in run])
    offsets = np.concatenate([[0], np.searchsorted(start, ends)])
    if not len(start):
        return np.zeros(0, U), start, end, offsets
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * power[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93)), start, end, offsets


_COEFFICIENTS = np.array([pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64) for k in range(64)], U)


def window_hashes(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words, and the index of each run's first word; runs don't cross texts."""
    n = len(h)
    if n < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = h[: n - size + 1] * _COEFFICIENTS[0]
    for k in range(1, size):
        acc += h[k : n - size + 1 + k] * _COEFFICIENTS[k]
    left = np.repeat(offsets[1:], np.diff(offsets))[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= left)
    return mix(acc[at]), at


def long_hashes(h: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """window_hashes for many words, by sums of powers: the cost doesn't depend on size."""
    n = len(h)
    if n < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(h * power[:n], out=total[1:])
    left = np.repeat(offsets[1:], np.diff(offsets))[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= left)
    return mix((total[at + size] - total[at]) * inverse[at] + U(size)), at


def shingles(h: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the text index of each; a text of 1 to size-1 words has one shingle of all its words."""
    s, at = window_hashes(h, offsets, size)
    owner = np.searchsorted(offsets, at, "right") - 1
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = [mix(np.array([(h[offsets[i] : offsets[i + 1]] * _COEFFICIENTS[: count[i]]).sum() + U(count[i])], U))[0] for i in short]
        s, owner = np.concatenate([s, np.array(extra, U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    return s, owner


def counted(s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, shingle) with the number of times each occurs, ordered by owner, then shingle."""
    if not len(s):
        return s, owner, np.zeros(0, np.int64)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(first)
    return s[at], owner[at], np.diff(np.concatenate([at, [len(s)]]))
