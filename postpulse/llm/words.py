"""Words of many texts at once, and their hashes."""

from __future__ import annotations

import numpy as np

PRIME = 0x9E3779B97F4A7C15
_PIECE = 1 << 20  # bytes hashed at a time
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts that stand one behind the other in ``data``.

    Where they start and end, each text's first word and number of words, and a hash of each.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.texts = data, len(ends)
        inner = ~_BREAK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before = np.concatenate([[False], inner])
        after = np.concatenate([inner, [False]])
        self.starts = np.nonzero(after & (~before | edge))[0]
        self.ends = np.nonzero(before & (~after | edge))[0]
        bounds = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        self.first = bounds[:-1]  # each text's first word
        self.count = np.diff(bounds)

    def hashes(self) -> np.ndarray:
        """Polynomial hashes of the words, from sums over a piece of the texts at a time."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            base = int(self.starts[i])
            j = max(int(np.searchsorted(self.ends, base + _PIECE, "right")), i + 1)
            part = self.data[base: self.ends[j - 1]].astype(np.uint64)
            power, inverse = _powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * power, out=sums[1:])
            first, last = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = (sums[last] - sums[first]) * inverse[first]
            i = j
        return mixed(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(PRIME))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse; kept for the next batch."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        back = pow(base, -1, 1 << 64)
        size = max(n, _PIECE)
        made = []
        for b in (base, back):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]
