"""A cuckoo filter over 64-bit hashes: approximate membership with deletion, in one numpy table."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Full(Exception):
    """No room within the allowed number of moves; build a larger filter from the exact table."""


class CuckooFilter:
    """16-bit prints in buckets of four. No false negatives for what was inserted and not deleted.

    Equal hashes inserted twice take two slots, so the exact table should insert each key once.
    """

    def __init__(self, capacity: int):
        n = 1
        while n * SLOTS * 0.85 < max(1, capacity):
            n *= 2
        self.slots = np.zeros((n, SLOTS), np.uint16)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(hashes).astype(np.int64).view(np.uint64) * _MIX
        h ^= h >> np.uint64(32)
        prints = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return prints, (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        jump = (prints.astype(np.uint64) * _MIX) >> np.uint64(20)
        return at ^ (jump & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _put(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places what fits, one in a bucket at a time; a mask of what was placed."""
        done = np.zeros(len(at), bool)
        for _ in range(SLOTS):
            left = np.nonzero(~done)[0]
            left = left[np.unique(at[left], return_index=True)[1]]
            free = self.slots[at[left]] == 0
            left, col = left[free.any(axis=1)], free.argmax(axis=1)[free.any(axis=1)]
            if not left.size:
                break
            self.slots[at[left], col] = prints[left]
            done[left] = True
        return done

    def insert(self, hashes: np.ndarray, moves: int = 500) -> None:
        prints, at = self._places(hashes)
        rng = np.random.default_rng(7)
        for _ in range(moves):
            for swap in (False, True):
                at = self._other(prints, at) if swap else at
                done = self._put(prints, at)
                prints, at = prints[~done], at[~done]
            if not at.size:
                return
            first = np.unique(at, return_index=True)[1]
            col = rng.integers(0, SLOTS, first.size)
            out = self.slots[at[first], col].copy()
            self.slots[at[first], col] = prints[first]
            prints[first] = out
            at[first] = self._other(out, at[first])
        raise Full

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, at = self._places(hashes)
        two = self._other(prints, at)
        return (self.slots[at] == prints[:, None]).any(axis=1) | (self.slots[two] == prints[:, None]).any(axis=1)

    def delete(self, hashes: np.ndarray) -> None:
        """Only hashes that were inserted may be deleted."""
        prints, at = self._places(hashes)
        for p, a, b in zip(prints, at, self._other(prints, at)):
            for i in (a, b):
                hit = np.nonzero(self.slots[i] == p)[0]
                if hit.size:
                    self.slots[i, hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        f = cls(1)
        f.slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return f

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        capacity = len(hashes)
        while True:
            f = cls(capacity)
            try:
                f.insert(hashes)
            except Full:
                capacity = max(capacity, 1) * 2
            else:
                return f
