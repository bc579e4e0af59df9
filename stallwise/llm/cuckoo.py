"""A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class CuckooFilter:
    """Set of hashes with insertion and deletion; never misses a member it holds.

    A filter that could not place every member is ``full``: it then answers yes to all,
    which costs exact look-ups and loses nothing.
    """

    def __init__(self, table: np.ndarray, full: bool = False):
        self.table = table
        self.full = full
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, members: int) -> CuckooFilter:
        """Room for twice ``members``."""
        buckets = 1 << max(4, int(2 * max(1, members) // SLOTS).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loaded(cls, data: bytes, full: bool) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy(), full)

    def dumped(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = (hashes >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        return marks, (hashes & self.mask).astype(np.int64)

    def _other(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        jump = marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return ((at.astype(np.uint64) ^ jump) & self.mask).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(hashes), bool)
        marks, at = self._places(hashes)
        other = self._other(marks, at)
        wanted = marks[:, None]
        return (self.table[at] == wanted).any(1) | (self.table[other] == wanted).any(1)

    def insert(self, hashes: np.ndarray, turns: int = 200) -> None:
        """Places all hashes at once; what finds no room pushes others to their second bucket."""
        marks, at = self._places(hashes)
        for turn in range(turns):
            order = np.argsort(at, kind="stable")
            marks, at = marks[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slots = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.table[at[fits], slots[fits]] = marks[fits]
            marks, at = marks[~fits], at[~fits]
            if not len(marks):
                return
            if turn % 2:
                # The first of every bucket takes a slot and sends its holder on.
                first = np.r_[True, at[1:] != at[:-1]]
                slot = turn // 2 % SLOTS
                held = self.table[at[first], slot]
                self.table[at[first], slot] = marks[first]
                marks[first] = held
            at = self._other(marks, at)
        self.full = True

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one copy of each hash; all must be members."""
        for mark, at in zip(*self._places(hashes), strict=True):
            other = int(self._other(np.array([mark]), np.array([at]))[0])
            for bucket in (int(at), other):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
