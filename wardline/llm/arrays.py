"""Numpy helpers over Arrow text columns: words, 64-bit hashes, shingles, moving minima.

All functions work on one bounded block of rows: ``blocks`` cuts Arrow batches into pieces
of about ``limit`` text bytes (a single longer row is a piece of its own), so that a task's
memory does not depend on how many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 512 << 10  # some arrays of eight bytes a byte each, in every worker of an executor
_RNG = np.random.Generator(np.random.PCG64(20260101))
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, BLOCK_BYTES + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps)
    return _POWERS[key][:n]


class Spans:
    """Hashes of any byte ranges of one block, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_HASH[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(INVERSE, len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of every range of ``k`` bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``flag`` that do not cross a row."""
    n = len(flag)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = flag[:-1]
    before[inner] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = flag[1:]
    after[inner - 1] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word; a word is a run of letters, digits and non-ASCII bytes."""
    start, end = runs(WORD_BYTE[data], offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    return row.astype(np.int64), Spans(data).hash(start, end)


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words; a row with fewer words has one shingle of all."""
    if len(row) == 0:
        return row, word
    mixed = mix(word)
    n = len(row) - k + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += mixed[j : j + n] * powers(BASE, k + 2)[j + 1]
        inside = row[:n] == row[k - 1 :]
        at, full = row[:n][inside], mix(total[inside])
    else:
        at, full = row[:0], word[:0]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[first, len(row)])
    short = first[length < k]
    if len(short) == 0:
        return at, full
    place = np.arange(len(row)) - np.repeat(first, length)
    weighted = np.add.reduceat(mixed * powers(BASE, int(length.max()) + 2)[np.minimum(place, k) + 1], first)
    at = np.r_[at, row[short]]
    full = np.r_[full, mix(weighted[length < k])]
    order = np.argsort(at, kind="stable")
    return at[order], full[order]


def moving_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def count_rows(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=n)
