"""Arrow batches of texts as flat numpy arrays: bytes, words and their hashes.

All helpers run inside tasks. A batch of documents is one byte array with
document offsets, so that splitting, hashing and counting are a few array
passes instead of a Python loop per word. A word is a maximal run of bytes
other than space, tab, line feed, vertical tab, form feed and carriage return
(`[^\\x20\\x09-\\x0D]+`), taken from the whole text; a null text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = U(0x9E3779B97F4A7C15 | 1)
LENGTH = 0xD6E8FEB86659FD93
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
#: One random 64-bit value per byte, from a fixed seed.
BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; kept for reuse up to 4 M."""
    size = max(1 << 19, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, BASE), np.full(size, BASE_INV)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:
            return made
        _POWERS.clear()
        _POWERS[size] = made
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence of values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end]
        out -= self.sums[start]
        out *= self.down[start]
        out += (end - start).astype(U) * U(LENGTH)
        return mix(out)

    def windows(self, n: int) -> np.ndarray:
        """Hash of every run of n values, by its start."""
        m = len(self.sums) - n
        if m <= 0:
            return np.zeros(0, U)
        out = self.sums[n:] - self.sums[:m]
        out *= self.down[:m]
        out += U(n * LENGTH % (1 << 64))
        return mix(out)


#: Longest range that the polynomial alone tells apart. Modulo a power of two it
#: repeats itself on some patterns, from 1,024 values on whatever the base.
SURE = 64


def range_hashes(values: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of a text, equal where the ranges are: by the
    polynomial of `values`, those over SURE by a digest of `raw`, the elements
    that the values stand for."""
    out = Rolling(values)(start, end)
    for i in np.flatnonzero(end - start > SURE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a batch of texts: byte range and document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        black = ~SPACE[data]
        begin = black.copy()
        begin[1:] &= ~black[:-1]
        close = black.copy()
        close[:-1] &= ~black[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = black[cut]
        close[cut - 1] = black[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        #: Words of document d: range(first[d], first[d + 1]).
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return range_hashes(BYTES[data], data, self.start, self.end)

    def within(self, n: int, docs: np.ndarray | None = None) -> np.ndarray:
        """For each word: is there a run of n words of its document from here?"""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.start)) + n <= last


def texts_of(batch: pa.RecordBatch, size: int = 1 << 18, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text; one row at least."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    lengths = np.diff(flat(col)[1])
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over ranges first[i]:first[i+1]; empty ranges give 0."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def spread(mask: np.ndarray, n: int) -> np.ndarray:
    """True at every position covered by a run of n that starts at a true one."""
    step = np.zeros(len(mask) + n + 1, np.int32)
    at = np.flatnonzero(mask)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step)[: len(mask)] > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs that don't cross documents: start, end, document."""
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    close = mask.copy()
    close[:-1] &= ~mask[1:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    begin[cut] = mask[cut]
    close[cut - 1] = mask[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return start, end, np.searchsorted(first, start, "right") - 1


def small_batches(df) -> None:
    """Arrow batches of at most 1 000 rows, so that a batch of long texts fits
    into a Python worker; a smaller setting stays."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 1001):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
