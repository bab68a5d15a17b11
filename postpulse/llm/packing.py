"""Packing documents into sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import in_tasks, named, written

LENGTH = 2048
END = 1  # the id behind every document
GROUP = 4096  # pieces in a group, on average
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# The first bytes of all white space beyond ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
_PIECES = ("id", "start", "length", "crc", "tokens", "grp", "tie")


class Tokens:
    """Ids of a byte-level BPE tokenizer file, taken the shortest way that gives the same ids."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content.encode() for t in
                        self.whole.get_added_tokens_decoder().values()]
        ranks = public_tokenizers.path(name.replace(".json", ".tiktoken"))
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.exact = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=merges,
                                       special_tokens={})
        # Only a run of two or more spaces before a word needs the pattern's look-ahead.
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""),
                                       mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: bytes) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text.decode(), add_special_tokens=False).ids
        space = _SPACE[np.frombuffer(text, np.uint8)]
        if (space[1:] & space[:-1]).any() or _WIDE.search(text):
            return self.exact.encode_ordinary(text.decode())
        return self.plain.encode_ordinary(text.decode())


@lru_cache(maxsize=1)
def tokens(name: str) -> Tokens:
    return Tokens(name)


def _cut(batches: Iterator[pa.RecordBatch], name: str, length: int, groups: int, seed: int
         ) -> Iterator[pa.RecordBatch]:
    """Pieces of every document: full sequences, and what is left at its end."""
    encode = tokens(name)
    for batch in batches:
        out: list[tuple] = []
        times: dict[bytes, int] = {}
        for key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            ids = np.array([*encode(text or b""), END], "<u4")
            # Copies of a row go to different groups: how often it came is part of the hash.
            mark = blake2b(f"{seed}:{key}:{zlib.crc32(ids)}".encode(), digest_size=8).digest()
            times[mark] = times.get(mark, 0) + 1
            for start in range(0, len(ids), length):
                piece = ids[start: start + length]
                at = blake2b(mark + f"{times[mark]}:{start}".encode(), digest_size=8).digest()
                tie = int.from_bytes(at, "little") >> 1
                out.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids),
                            tie % groups, tie))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(len(_PIECES))], _PIECES)


class Bins:
    """Bins of equal capacity under a tournament tree of what each has left."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.tree = [0, capacity]

    def _grow(self) -> None:
        left = [self.tree[self.leaves + i] for i in range(self.leaves)] + \
            [self.capacity] * self.leaves
        self.leaves *= 2
        self.tree = [0] * self.leaves + left
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and what it held before."""
        tree = self.tree
        if tree[1] < size:
            self._grow()
            tree = self.tree
        i = 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        held = self.capacity - tree[i]
        number = i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        self.used = max(self.used, number + 1)
        return number, held


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; ``sizes`` come in decreasing order."""
    bins = Bins(capacity)
    return [bins.place(size) for size in sizes]


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and decreasing length; a group may span batches."""
    group, bins = None, Bins(length)
    for batch in batches:
        grp, size = (batch.column(_PIECES.index(c)).to_pylist() for c in ("grp", "length"))
        number, offset = [], []
        for g, n in zip(grp, size, strict=True):
            if g != group:
                group, bins = g, Bins(length)
            at, held = bins.place(n)
            number.append(g << 32 | at)
            offset.append(held)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(5)), pa.array(number, pa.int64()),
             pa.array(offset, pa.int64())],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH,
         group: int = GROUP, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in sequences of at most ``length`` tokens.

    A document's ids are those of its text and the id 1. It is cut into full sequences and a rest;
    the pieces go to random groups of about ``group`` by a hash, and each group is packed
    by first-fit decreasing: the first bin with room is found in a tournament tree of room left.

    Output, one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (group
    and bin), offset. Null and empty texts have the one id 1. Repeated rows are packed each for
    itself. Null keys stay null. An empty table gives an empty one. Other columns aren't read.

    The number of groups follows the number of pieces, which are written first; a task streams its
    sorted pieces and holds one group's tree. Where a task is repeated it makes the same pieces.
    """
    rows = docs.select(named(key).cast("long").alias("id"),
                       named(text).cast("binary").alias("text"))
    spread = 1 << 31  # of the first hash; the groups are taken from it below
    kind = ", ".join(f"{c} long" for c in _PIECES)
    pieces = written(in_tasks(rows, 
        partial(_cut, name=tokenizer, length=length, groups=spread, seed=seed), kind), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("grp", F.col("grp") % groups).repartition("grp")
    ordered = dealt.sortWithinPartitions("grp", F.desc("length"), "tie").select(*_PIECES)
    return in_tasks(ordered, 
        partial(_pack, length=length), "doc_id long, start long, length long, ids_crc32 long, "
        "doc_tokens long, sequence_id long, offset long")
