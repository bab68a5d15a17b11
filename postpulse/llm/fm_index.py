"""A compressed FM-index over integer symbols: Burrows-Wheeler text in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector, 64 bits to a word, with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank of any symbol before any position, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels, self.zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` stands before ``at[i]``, less the symbol's start on the last level."""
        width = len(self.levels)
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            one = (symbol >> (width - 1 - i) & 1).astype(bool)
            at = np.where(one, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search for patterns of at most ``depth`` symbols in a text of symbols from 0 on.

    Suffixes are ordered by their first ``depth`` symbols only (equal ones by position), which is
    all that the search of such patterns needs.
    """

    def __init__(self, text: np.ndarray, depth: int):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0 ends the text
        n = len(text)
        _, order = np.unique(text, return_inverse=True)
        have = 1
        while have < depth:
            step = min(have, depth - have)
            tail = np.zeros(n, np.int64)
            tail[: max(n - step, 0)] = order[step:] + 1
            _, order = np.unique(order * (n + 1) + tail, return_inverse=True)
            have += step
        suffixes = np.argsort(order, kind="stable")
        self.size = n
        self.symbols = int(text.max()) + 1
        self.width = max(1, int(self.symbols - 1).bit_length())
        self.tree = WaveletMatrix(text[suffixes - 1], self.width)
        counts = np.bincount(text, minlength=self.symbols)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # rank() counts from where a symbol starts on the tree's last level.
        every = np.arange(self.symbols)
        self.shift = starts - self.tree.rank(every, np.zeros(self.symbols, np.int64))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol in front."""
        symbol = symbol + 1
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[: len(symbol)] + shift, both[len(symbol):] + shift

    def search(self, text: np.ndarray, starts: np.ndarray, length: int
               ) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the runs of ``length`` symbols of ``text`` from ``starts``.

        Matching is against the index's own text or any other over the same symbols. A run whose
        interval has at most one row is not followed further; it then gets (-1, -1).
        """
        low = np.full(len(starts), -1, np.int64)
        high = low.copy()
        alive = np.arange(len(starts))
        a, b = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for back in range(length - 1, -1, -1):
            a, b = self.step(text[starts[alive] + back], a, b)
            go = b - a > 1
            if not go.all():
                alive, a, b = alive[go], a[go], b[go]
        low[alive], high[alive] = a, b
        return low, high
