"""Words of a text in one line, and rolling hashes of their sequences, in numpy."""

from __future__ import annotations

import numpy as np

#: Words that are hashed at a time.
HASH_WORDS = 1 << 14

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """A text's words in one line with single spaces, and their places in it."""

    def __init__(self, text: bytes, clean: bool = False):
        self.line = text if clean else b" ".join(text.split())
        raw = np.frombuffer(self.line, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 0x20)
        self.starts = np.r_[0, gaps + 1] if len(raw) else np.zeros(0, dtype=np.int64)
        self.ends = np.r_[gaps, len(raw)] if len(raw) else np.zeros(0, dtype=np.int64)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, k: int) -> np.ndarray:
        """A hash of every k words."""
        n = len(self) - k + 1
        out = np.empty(max(n, 0), dtype=np.uint64)
        for lo in range(0, n, HASH_WORDS):
            hi = min(lo + HASH_WORDS, n)
            first, last = self.starts[lo], self.ends[hi + k - 2]
            up, down = powers(int(last - first) + 1)
            sums = np.zeros(int(last - first) + 1, dtype=np.uint64)
            np.cumsum((self.raw[first:last] + np.uint64(1)) * up[:-1], out=sums[1:])
            s, e = self.starts[lo:hi] - first, self.ends[lo + k - 1 : hi + k - 1] - first
            x = (sums[e] - sums[s]) * down[s]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[lo:hi] = x ^ (x >> np.uint64(32))
        return out

    def slice(self, first: int, k: int) -> bytes:
        """The k words from ``first`` on."""
        return self.line[self.starts[first] : self.ends[first + k - 1]]
