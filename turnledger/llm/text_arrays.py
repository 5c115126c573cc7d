"""Words of a whole text column as numpy arrays: boundaries, row offsets and 64-bit hashes.

Tasks call these on Arrow batches. No Python object is made per word; a batch is cut into
chunks of about ``CHUNK`` bytes (at least one row), so memory depends on the chunk and on
the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_P1 = 0x9E3779B97F4A7C15
_P2 = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = np.bitwise_xor(x, x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= CHUNK + 1:  # those of a longer text are not kept
            _powers[base] = have
    return have


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and factors: mix((sums[b] - sums[a]) * factors[a]) is the hash of bytes a to b."""
    up, down = _power_tables(_P1, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[128:] = True
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _ALNUM[list(_r)] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)

#: Word bytes: everything but ASCII white space, or ASCII letters and digits and all non-ASCII.
PLAIN, ALNUM = ~_SPACE, _ALNUM


@dataclass
class Words:
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds.astype(np.int64)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool, second: bool = False):
    """Words of the rows of one chunk. ``fold`` hashes A-Z as a-z. ``second``: also an
    independent hash."""
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    opens[at] = inside[at]
    at = offsets[1:][filled] - 1
    closes[at] = inside[at]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    codes = (_FOLD if fold else np.arange(1, 257, dtype=np.uint64))[data]

    def hashed(base: int) -> np.ndarray:
        up, down = _power_tables(base, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])

    words = Words(data, offsets, start, end, first, hashed(_P1))
    return (words, hashed(_P2)) if second else words


def chunked_words(column, kind: np.ndarray, fold: bool, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for the chunks of a column."""
    data, offsets = text_buffer(column)
    for low, high in row_chunks(offsets, limit):
        yield low, high, split_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], kind, fold)


_GRAM = [pow(0xFF51AFD7ED558CCD, i, 1 << 64) for i in range(64)]


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` neighbours from each position on, also across rows."""
    n = max(0, len(values) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += values[i : i + n] * np.uint64(_GRAM[i % 64])
    return mix(out)


def gram_positions(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``size`` words of one row start, and the row of each."""
    row = words.row_of()
    n = len(words.start)
    ok = np.arange(n) + size <= words.first[1:][row] if n else np.zeros(0, bool)
    return np.flatnonzero(ok), row[ok]


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word shingle; a row of 1 to ``size``-1 words is one shingle."""
    at, row = gram_positions(words, size)
    values = grams(words.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = words.counts[short] > i
            extra[has] += words.hash[words.first[:-1][short[has]] + i] * np.uint64(_GRAM[i + size])
        values, row = np.concatenate([values, mix(extra)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    return values, row
