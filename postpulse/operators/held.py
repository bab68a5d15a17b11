"""Keywords that texts hold, by work on arrays: for very many keywords and many texts in a task.

Everything is compared byte by byte. A keyword without a space stands within one of the pieces between
spaces, so what a piece holds is found out once and kept; others are looked for in whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"  # where Arrow splits
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 18  # places looked at together
SLICE = 1 << 21  # bytes of text split together
# Pieces and what they hold: at so many a task keeps no more. Longer pieces are looked into each time.
KNOWN, KNOWN_HITS, LONGEST = 1 << 18, 1 << 23, 64


class Bits:
    """Whether a hash may be one of those added; it may say yes to some that aren't."""

    def __init__(self, most: int):
        bits = min(max((8 * most).bit_length(), 10), 30)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits - 3, np.uint8)

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (hashes * SPREAD >> self.shift).astype(np.int64)
        return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        np.bitwise_or.at(self.table, *self._at(hashes))

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        at, bit = self._at(hashes)
        return self.table[at] & bit != 0


class Index:
    """Keywords, none empty and none twice, to be found wherever they stand in texts."""

    def __init__(self, keywords: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(keywords), np.uint8)
        self.size = np.array([len(k) for k in keywords], np.int64)
        self.start = np.cumsum(self.size) - self.size
        # Of each keyword's beginnings, so that places where none goes on are left at once.
        self.begun, self.whole = Bits(len(self.data)), Bits(2 * len(keywords))
        hashes = np.zeros(len(keywords), np.uint64)
        left, h, n = np.arange(len(keywords)), np.zeros(len(keywords), np.uint64), 0
        while len(left):
            h = h * FACTOR + self.data[self.start[left] + n] + np.uint64(1)
            n += 1
            self.begun.add(h)
            done = self.size[left] == n
            hashes[left[done]] = h[done]
            left, h = left[~done], h[~done]
        self.whole.add(hashes)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        # Keywords that share a hash are tried one after the other.
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, keyword) by item: ``data`` holds the items, ``ends`` where each ends. Pairs may repeat."""
        items, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(data), CHUNK):
            at = np.arange(low, min(low + CHUNK, len(data)))
            first, last = np.searchsorted(ends, at[[0, -1]], "right")
            here = np.minimum(ends[first: last + 1], at[-1] + 1)
            item = np.repeat(np.arange(first, last + 1), np.diff(here, prepend=low))
            h, n = np.zeros(len(at), np.uint64), 0
            pairs, many = [], 0
            while len(at):
                h = h * FACTOR + data[at + n] + np.uint64(1)
                n += 1
                going = np.flatnonzero(self.begun.may_have(h))
                at, item, h = at[going], item[going], h[going]
                maybe = np.flatnonzero(self.whole.may_have(h))
                for which, k in self._equal(data, at[maybe], h[maybe], n):
                    pairs.append(item[maybe[which]] * len(self.size) + k)
                    many += len(k)
                if many > 4 * CHUNK:  # some come again and again
                    pairs, many = [np.unique(np.concatenate(pairs))], 0
                going = np.flatnonzero(ends[item] - at > n)
                at, item, h = at[going], item[going], h[going]
            if pairs:
                item, k = np.divmod(np.concatenate(pairs), len(self.size))
                items.append(item)
                found.append(k)
        item, k = np.concatenate(items), np.concatenate(found)
        order = np.argsort(item, kind="stable")
        return item[order], k[order]

    def _equal(self, data: np.ndarray, at: np.ndarray, h: np.ndarray, n: int
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number among ``at``, keyword) where the ``n`` bytes of that hash are a keyword."""
        first = np.searchsorted(self.hashes, h) if len(h) else h
        for again in range(self.alike if len(h) else 0):
            near = np.minimum(first + again, len(self.hashes) - 1)
            k = self.order[near]
            same = np.flatnonzero((self.hashes[near] == h) & (self.size[k] == n) & (first + again == near))
            which, k = same, k[same]
            for j in range(n):
                same = data[at[which] + j] == self.data[self.start[k] + j]
                if not same.all():
                    which, k = which[same], k[same]
            if len(k):
                yield which, k


class Counter:
    """Texts that hold each keyword."""

    def __init__(self, within: Index | None, across: Index | None):
        self.within, self.across = within, across
        self.texts = 0
        self.n_within, self.n_across = (np.zeros(len(x.size) if x else 0, np.int64) for x in (within, across))
        self.last = np.zeros(len(self.n_within), np.int64)
        self.numbers = np.arange(1 << 12)
        self.known: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int32)

    def add(self, texts: pa.Array) -> None:
        texts = texts.drop_null().cast(pa.large_binary())
        self.texts += len(texts)
        ends, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while low < len(texts):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")), low + 1)
            some = texts[low:high]
            if self.within:
                self._add_within(some)
            if self.across:
                plain = some.to_pylist()
                item, k = self.across.find(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([len(t) for t in plain]))
                once = np.unique(item * len(self.n_across) + k)
                self.n_across += np.bincount(once % len(self.n_across), minlength=len(self.n_across))
            low = high

    def _add_within(self, texts: pa.Array) -> None:
        pieces = pc.ascii_split_whitespace(texts.view(pa.large_string()))
        coded = pieces.flatten().dictionary_encode()
        rows, start, size, hits = self._rows(coded.dictionary.view(pa.large_binary()).to_pylist())
        rows, bounds = rows[coded.indices.to_numpy()], pieces.offsets.to_numpy().tolist()
        first, many = start[rows], size[rows]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            size = many[low:high]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            if not total:
                continue
            if total > len(self.numbers):
                self.numbers = np.arange(2 * total)
            number = self.numbers[:total]
            ids = hits[np.repeat(first[low:high] - ends + size, size) + number].astype(np.int64)
            # Of the places where a keyword stands one is left in ``last``, so it counts once.
            self.last[ids] = number
            self.n_within[ids[self.last[ids] == number]] += 1

    def _rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its number in start and size, these two, and the hits that they are places in."""
        get = self.known.get
        rows = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        unknown = np.flatnonzero(rows < 0)
        if not len(unknown):
            return rows, self.start, self.size, self.hits
        new = [pieces[i] for i in unknown.tolist()]
        item, k = self.within.find(np.frombuffer(b"".join(new), np.uint8), np.cumsum([len(p) for p in new]))
        size, begin = np.bincount(item, minlength=len(new)), len(self.start)
        rows[unknown] = np.arange(begin, begin + len(new))
        start = np.concatenate([self.start, len(self.hits) + np.cumsum(size) - size])
        size, hits = np.concatenate([self.size, size]), np.concatenate([self.hits, k.astype(np.int32)])
        # The first ones are kept, among which common ones are.
        if len(self.known) < KNOWN and len(self.hits) < KNOWN_HITS:
            self.known.update((p, begin + i) for i, p in enumerate(new) if len(p) <= LONGEST)
            self.start, self.size, self.hits = start, size, hits
        return rows, start, size, hits


class Keywords:
    """Keywords as tasks get them."""

    def __init__(self, keywords: Iterable[bytes]):
        listed = sorted(set(keywords))
        self.empty = listed[:1] == [b""]
        listed = listed[self.empty:]
        spaced = {k for k in listed if len(k) != len(k.translate(None, SPACES))}
        parts = [k for k in listed if k not in spaced], sorted(spaced)
        self.listed = [pa.array(p, pa.binary()) for p in parts]
        self.within, self.across = (Index(p) if p else None for p in parts)


def count_held(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(keyword, n) of a task's texts (one binary column), for the keywords that were found.

    ``shared`` is a broadcast ``Keywords``.
    """
    known = shared.value
    counter = Counter(known.within, known.across)
    for batch in batches:
        counter.add(batch.column(0))
    if known.empty and counter.texts:
        yield pa.record_batch({"keyword": pa.array([b""], pa.binary()), "n": pa.array([counter.texts], pa.int64())})
    for listed, counts in zip(known.listed, (counter.n_within, counter.n_across), strict=True):
        found = np.flatnonzero(counts)
        for low in range(0, len(found), CHUNK):
            some = found[low: low + CHUNK]
            yield pa.record_batch({"keyword": listed.take(pa.array(some)), "n": pa.array(counts[some])})
