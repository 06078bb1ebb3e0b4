"""An FM-index over a sequence of symbols, searched for many patterns at once.

The index holds the Burrows-Wheeler transform in a wavelet matrix of packed bit planes, with a count for each
64 bits, so rank needs one lookup and one popcount a level.  The suffix array is kept to report places.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth symbols or more, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:-k or n] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.ones(n, np.int64)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            break
        k *= 2
    return order


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        s = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            padded = np.zeros(-(-(len(s) + 1) // 64) * 64, np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view(U)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            zeros = len(s) - int(bit.sum())
            self.planes.append((words, before, zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def rank(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank at low and at high."""
        first = np.zeros(len(c), np.int64)
        for k, (words, before, zeros) in enumerate(self.planes):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            f, lo, hi = (self._ones(words, before, x) for x in (first, low, high))
            first = np.where(one, zeros + f, first - f)
            low = np.where(one, zeros + lo, low - lo)
            high = np.where(one, zeros + hi, high - hi)
        return low - first, high - first


class FMIndex:
    """Over runs of symbols 1..n_symbols - 1, each ended by a 0; depth: the longest pattern that will be asked for."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        self.suffixes = suffix_array(text, depth)
        self.tree = WaveletMatrix(text[self.suffixes - 1], n_symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with a symbol put before them."""
        lo, hi = self.tree.rank(symbol, low, high)
        return self.less[symbol] + lo, self.less[symbol] + hi

    def matching(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text up to a threshold.

        For each end: how many symbols up to there, threshold at most, occur at least twice in the index, and the range
        of suffixes that begin with those symbols.
        """
        length = np.zeros(len(ends), np.int64)
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), self.size)
        live = np.arange(len(ends))
        lo, hi = low.copy(), high.copy()
        for j in range(threshold):
            lo, hi = self.extend(text[ends[live] - 1 - j], lo, hi)
            keep = hi - lo > 1
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
            length[live] = j + 1
            low[live], high[live] = lo, hi
        return length, low, high
