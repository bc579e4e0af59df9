"""Hashes of words and word runs from one pass over the bytes of a text."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up), 1 << 14)
            for name, factor in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of a hash depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a text joined by single spaces, with hashes of any run of them."""

    def __init__(self, words: list[bytes], powers: Powers):
        self.joined = b" ".join(words)
        self.bytes = np.frombuffer(self.joined, np.uint8)
        self.count = len(words)
        gaps = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if words else np.zeros(0, np.int64)
        self.ends = np.concatenate([gaps, [len(self.bytes)]]) if words else np.zeros(0, np.int64)
        powers.reach(len(self.bytes))
        self.powers = powers
        self.sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(LETTERS[self.bytes] * powers.up[: len(self.bytes)], out=self.sums[1:])

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words ``first`` to ``last``, both included."""
        begin, end = self.starts[first], self.ends[last]
        return mixed((self.sums[end] - self.sums[begin]) * self.powers.down[begin])

    def grams(self, size: int) -> np.ndarray:
        n = self.count - size + 1
        at = np.arange(max(0, n))
        return self.runs(at, at + size - 1)
