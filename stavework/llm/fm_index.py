"""A compressed FM-index over word sequences, in numpy.

Only the Burrows-Wheeler transform is kept, in a wavelet matrix of packed bits with one
count for every 64; the order of suffixes that it is made from is not, nor is the text.
Suffixes are sorted by as many words as the longest pattern has, or more, which is exact
for patterns up to that length. Many patterns are searched at once: each step of a
backward search is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np

#: Longest pattern, if nothing else is said.
DEPTH = 32
SEPARATOR = 0


class RankBits:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """An index of ``text`` (symbols from 0; SEPARATOR stands between sequences).

    depth: the longest pattern.
    """

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        last = text[suffix_order(text, depth) - 1]  # the transform; before the first symbol comes the last
        self.levels = max(1, int(text.max()).bit_length())
        self.smaller = np.r_[0, np.cumsum(np.bincount(text))]
        self.bits, row = [], last
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.bits.append(RankBits(bit.astype(np.uint8)))
            row = np.r_[row[bit == 0], row[bit == 1]]
        symbols = np.arange(int(text.max()) + 1)
        self.base = self._walk(symbols, np.zeros(len(symbols), dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            ones = bits.ones(at)
            at = np.where((symbols >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of symbol + pattern from the ranges of the patterns."""
        both = self._walk(np.r_[symbols, symbols], np.r_[low, high])
        start = self.smaller[symbols] - self.base[symbols]
        return both[: len(low)] + start, both[len(low) :] + start

    def matches(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed symbols against this index, up to ``most``.

        For each place in ``ends``: the length of the longest sequence that ends there and
        occurs at least twice in the index (the streamed symbols are part of it), and the
        first suffix of its range, which names the sequence if it has ``most`` symbols. At
        least ``most`` symbols must stand before each end. Backward search, one symbol to
        the left in each step; a range of one suffix is not followed further.
        """
        length, name = np.zeros(len(ends), dtype=np.int32), np.full(len(ends), -1, dtype=np.int64)
        active, at = np.arange(len(ends)), ends
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.smaller[-1], dtype=np.int64)
        for _ in range(most):
            low, high = self.step(text[at], low, high)
            more = high - low > 1
            if not more.all():
                active, at, low, high = active[more], at[more], low[more], high[more]
            if not len(active):
                break
            length[active] += 1
            at = at - 1
        name[active] = low
        return length, name

    @property
    def nbytes(self) -> int:
        return sum(b.words.nbytes + b.before.nbytes for b in self.bits) + self.smaller.nbytes + self.base.nbytes


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols or more, in any order where these are equal.

    Ranks of the first few symbols, as many as fit in 63 bits, then ranks of doubled
    length until all differ.
    """
    n, rank = len(text), text.astype(np.int64)
    bits = max(1, int(rank.max(initial=0) + 1).bit_length())
    width = max(1, min(63 // bits, depth))
    key = rank + 1
    for k in range(1, width):
        key = key << bits
        key[: max(n - k, 0)] |= rank[k:] + 1
    while True:
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if width >= depth or new[-1:] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        key = rank * (int(new[-1]) + 2)
        key[: max(n - width, 0)] += rank[width:] + 1
        width *= 2
