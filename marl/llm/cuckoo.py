"""A cuckoo filter over 64-bit hashes: four 16-bit fingerprints a bucket, vectorised, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.80
#: Relocations tried for one fingerprint before the filter counts as full.
MAX_KICKS = 400
_MIX = np.uint64(0x9E3779B97F4A7C15)


class FilterFull(Exception):
    """No place for a fingerprint; the owner rebuilds a larger filter from its stored keys."""


class CuckooFilter:
    """Membership of distinct 64-bit hashes: no false negatives, about 2 * 4 / 65536 false positives.

    `insert` and `delete` take hashes that are distinct within a call; `delete` takes only hashes that
    were inserted. An empty array is a no-op everywhere.
    """

    def __init__(self, capacity: int = 64) -> None:
        n = 1
        while n * SLOTS * LOAD < max(1, capacity):
            n *= 2
        self.table = np.zeros((n, SLOTS), np.uint16)
        self.size = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.uint64)
        mask = np.uint64(len(self.table) - 1)
        mark = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (h & mask).astype(np.int64)
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * _MIX >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        """Raises FilterFull when a fingerprint finds no place; the filter is then to be rebuilt."""
        mark, first, second = self._places(hashes)
        left = np.arange(len(mark))
        for bucket in (first, second):
            left = self._fill(mark, bucket, left)
        for i in left:
            self._kick(mark[i], int(second[i]))
        self.size += len(mark)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Places what fits without moving anything; returns the rest."""
        for _ in range(SLOTS):
            if not len(left):
                break
            _, one = np.unique(bucket[left], return_index=True)  # one new fingerprint a bucket and round
            chosen = left[one]
            free = self.table[bucket[chosen]] == 0
            fits = free.any(axis=1)
            at = chosen[fits]
            self.table[bucket[at], free[fits].argmax(axis=1)] = mark[at]
            left = np.setdiff1d(left, at, assume_unique=True)
        return left

    def _kick(self, mark: np.uint16, bucket: int) -> None:
        for n in range(MAX_KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
            slot = (n * 7 + bucket) % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket ^= int(self._step(np.array([mark], np.uint16))[0])
        raise FilterFull

    def delete(self, hashes: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(hashes), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    self.size -= 1
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        made.size = int(np.count_nonzero(made.table))
        return made


def filter_of(hashes: np.ndarray, capacity: int = 64) -> CuckooFilter:
    """A filter that holds all the hashes, grown until they fit."""
    capacity = max(capacity, len(hashes))
    while True:
        made = CuckooFilter(capacity)
        try:
            made.insert(hashes)
            return made
        except FilterFull:
            capacity *= 2
