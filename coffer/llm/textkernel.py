"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on the UTF-8 bytes of many documents at once. A word's hash comes from
differences of one running polynomial sum, so no Python loop runs per word or per document.
Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
SHINGLE = 5
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a fresh uint64 array."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _byte_values() -> np.ndarray:
    v = stream(256, 77)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


_BYTE_VALUES = _byte_values()
_SHINGLE_C = stream(SHINGLE, 91) | U64(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the bytes in the given inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words are runs of anything but white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and all beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INV)):
                p = np.full(size, base, dtype=U64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold about ``limit`` bytes; a longer text stands alone, whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, min(at + MOST_ROWS, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Hashes and byte spans of all words of a chunk. Words of row r: first[r] to first[r+1]."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray, fold: bool = True):
        data, off = utf8(column)
        self.data, self.offsets = data, off
        n = len(data)
        w = np.zeros(n + 2, dtype=bool)
        w[1:-1] = word_bytes[data]
        begin, end = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
        inner = off[:-1][off[:-1] < n]
        begin[inner] = w[1:-1][inner]
        last = off[1:][off[1:] > 0] - 1
        end[last] = w[1:-1][last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        up, down = Powers.upto(n + 1)
        values = _BYTE_VALUES if fold else stream(256, 78)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(values[data] * up[:n], out=total[1:])
        self.total = total
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` (at most five) consecutive words, in text order, and the row bounds into them. A row of fewer
    words, but not none, has its whole sequence as the only shingle; a row of none has none."""
    h, n = words.hash, words.counts()
    per = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per) + np.repeat(words.first[:-1], per)
    padded = np.concatenate([h, np.zeros(size, U64)])
    out = np.zeros(len(at), dtype=U64)
    for j in range(size):
        out += padded[at + j] * _SHINGLE_C[j]
    for r in np.flatnonzero((n > 0) & (n < size)):
        out[bounds[r]] = (h[words.first[r] : words.first[r + 1]] * _SHINGLE_C[: n[r]]).sum() + U64(int(n[r]))
    return mix(out), bounds


#: Rows of a chunk at most, as their number takes the top bits of a sort key.
MOST_ROWS = 4096
_LOW = U64((1 << 52) - 1)


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit hashes of each row, and the new row bounds."""
    key = values & _LOW
    key |= np.repeat(np.arange(len(bounds) - 1, dtype=U64) << U64(52), np.diff(bounds))
    key.sort()
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    heads = np.searchsorted(key, np.arange(len(bounds) - 1, dtype=U64) << U64(52))
    return key & _LOW, np.append(heads, len(key))
