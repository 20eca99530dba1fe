"""Encodes texts by segments and remembers the ids of each segment by its 64-bit hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from coffer.llm.textkernel import U64, Powers, mix, stream

_VALUES = stream(256, 78)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class HashIndex:
    """Numbers distinct 64-bit hashes in the order in which they come, by open addressing over whole arrays."""

    def __init__(self, room: int = 1 << 16):
        self.n = 0
        self._size(room)

    def _size(self, room: int) -> None:
        self.mask = U64(room - 1)
        self.keys, self.number = np.zeros(room, dtype=U64), np.zeros(room, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for an unknown one."""
        at = keys & self.mask
        there = self.keys[at]
        out = np.where(there == keys, self.number[at], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + U64(1) & self.mask
            key = keys[open_]
            there = self.keys[at]
            hit = there == key
            out[open_[hit]] = self.number[at[hit]]
            more = ~hit & (there != 0)
            open_, at = open_[more], at[more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers new distinct hashes."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = np.argsort(np.where(self.keys != 0, self.number, self.n), kind="stable")[: self.n]
            old, room = self.keys[held], len(self.keys)
            while room < 4 * (self.n + len(keys)):
                room *= 2
            self._size(room)
            self._put(old, np.arange(len(old), dtype=np.int32))
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = keys & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several that want a place the last gets it
            mine = free & (self.keys[at] == keys)
            self.number[at[mine]] = numbers[mine]
            keys, numbers, at = keys[~mine], numbers[~mine], at[~mine] + U64(1) & self.mask


class WordCache:
    """ids of segments. ``encode`` takes a list of new segments' bytes and gives all their ids and each one's number of them.
    Once it holds ``limit`` segments it starts afresh, so its memory is bounded; results never depend on it."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.off, self.n = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 18, dtype=np.int32), 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        return array if used + more <= len(array) else np.concatenate([array[:used], np.zeros(max(more, used), array.dtype)])

    def _add(self, keys: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        k, m = self.index.n, len(keys)
        self.off, self.n, self.pool = self._room(self.off, k, m), self._room(self.n, k, m), self._room(self.pool, self.used, len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.off[k : k + m], self.n[k : k + m] = self.used + np.cumsum(n) - n, n
        self.used += len(flat)
        self.index.add(keys)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in order, and how many each has."""
        keys = segment_hashes(data, starts, ends)
        keys[keys == 0] = 1
        if self.index.n > self.limit:
            self.clear()
        number = self.index.find(keys)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new, first = np.unique(keys[lost], return_index=True)
            first, raw = lost[first], data.tobytes()
            self._add(new, *self.encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            number[lost] = self.index.find(keys[lost])
        per = self.n[number].astype(np.int64)
        ends_ = np.cumsum(per)
        at = np.arange(ends_[-1] if len(ends_) else 0) - np.repeat(ends_ - per - self.off[number], per)
        return self.pool[at], per
