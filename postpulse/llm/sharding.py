"""Contiguous shards of least greatest size, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.common import named, written

FIRST, NEXT = 4, 3  # hex digits of the order key that a first and a deeper look tell apart
HEAVY = 256  # a group with over 1 / HEAVY of the rows is dealt over so many cells


class _Prefixes:
    """Sums of group sizes along the order of group keys, looked at only as finely as needed.

    ``nodes`` are key prefixes in order with the bytes, rows and number of groups below
    each. A look into some nodes replaces them by longer prefixes in one job; what is held
    grows with the looks (16^4 nodes, then 16^3 per node looked into), not with the corpus.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes: list[tuple[str, int, int, int]] = self._sums(groups, FIRST)
        self._add_up()

    def _sums(self, groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        found = groups.groupBy(F.substring("grp", 1, digits).alias("p")).agg(
            F.sum("bytes"), F.sum("rows"), F.count(F.lit(1)))
        return sorted(tuple(r) for r in found.collect())

    def _add_up(self) -> None:
        self.ends = list(accumulate(n[1] for n in self.nodes))
        self.row_ends = list(accumulate(n[2] for n in self.nodes))

    def look_into(self, places: set[int]) -> None:
        by_digits: dict[int, list[str]] = {}
        for i in places:
            by_digits.setdefault(len(self.nodes[i][0]), []).append(self.nodes[i][0])
        gone, more = set(), []
        for digits, prefixes in by_digits.items():
            within = F.lit(False)
            for p in prefixes:
                within = within | ((F.col("grp") >= p) & (F.col("grp") < p + "g"))
            more += self._sums(self.groups.where(within), digits + NEXT)
            gone |= set(prefixes)
        self.nodes = sorted([n for n in self.nodes if n[0] not in gone] + more)
        self._add_up()

    def greedy(self, capacity: int, shards: int) -> tuple[list[int] | None, set[int]]:
        """Node numbers at which shards start if filled up to ``capacity``, and unclear nodes.

        Cuts are made between nodes, so what fits this way fits for certain. A node of several
        groups at which a shard ends is unclear: a finer look may move the cut into it.
        Without cuts: it doesn't fit, or not in this coarse way.
        """
        cuts, unclear, start, done = [0], set(), 0, 0
        for _ in range(shards):
            stop = bisect_right(self.ends, done + capacity, lo=start)
            if stop == len(self.nodes):
                return cuts, unclear
            if self.nodes[stop][3] > 1:
                unclear.add(stop)
            if stop == start:
                return None, unclear
            start, done = stop, self.ends[stop - 1]
            cuts.append(stop)
        return None, unclear

    def hopeless(self, capacity: int, shards: int) -> bool:
        """Whether it doesn't fit even if every shard may take its last node whole."""
        done, start = 0, 0
        for _ in range(shards):
            stop = bisect_right(self.ends, done + capacity, lo=start)
            if stop + (stop < len(self.nodes) and self.nodes[stop][3] > 1) >= len(self.nodes):
                return False
            stop += self.nodes[stop][3] > 1
            if stop == start:
                return True
            start, done = stop, self.ends[stop - 1]
        return True

    def feasible(self, capacity: int, shards: int) -> bool:
        """The greedy check, looked at only as finely as the answer takes."""
        while True:
            cuts, unclear = self.greedy(capacity, shards)
            if cuts is not None:
                return True
            if not unclear or self.hopeless(capacity, shards):
                return False
            self.look_into(unclear)

    def cut(self, capacity: int, shards: int) -> list[int]:
        """The greedy cuts at a feasible capacity, exact to the group."""
        while True:
            cuts, unclear = self.greedy(capacity, shards)
            if not unclear:
                return cuts
            self.look_into(unclear)


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[list[str], list[int], int]:
    """Binary search: the first keys of the shards, the rows before each, and the capacity."""
    known = _Prefixes(groups)
    if not known.nodes:
        return [], [], 0
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if known.feasible(middle, shards):
            high = middle
        else:
            low = middle + 1
    cuts = known.cut(low, shards)
    return ([known.nodes[c][0] for c in cuts],
            [known.row_ends[c - 1] if c else 0 for c in cuts], low)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in ``shards`` contiguous shards, equal texts together, sizes near equal.

    Documents are ordered by the SHA-256 of their text, so equal texts are one atomic group. The
    smallest capacity into which the ordered groups can be filled greedily is found by binary
    search, and the shards are cut there. Law ``bytes``: a size is the text's UTF-8 bytes and 1.

    Output: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), one row
    per row of ``docs``. ``slot`` counts from 0 without gaps along (text digest, a salt in
    groups that fill a large part of the table, key). Null texts are one group of size 1 and
    checksum 0; null keys come first; repeated rows get slots of their own; fewer groups than
    shards leave shards empty; an empty table gives an empty one. Other columns aren't read.

    Prefix sums are kept per key prefix (at most 16^4 rows reach the driver at first, then 16^3
    per place where a cut may lie). Slots are counted within prefixes; a group with over
    1 / 256 of all rows is dealt over cells by a hash of the key, and over 256 equal rows in it are
    dealt over all cells. Equal rows are counted, not sorted.
    """
    sized = written(docs.select(
        named(key).alias("doc_id"),
        (F.coalesce(F.octet_length(named(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(named(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(named(text).cast("binary"), 256), F.lit("")).alias("grp"),
    ).groupBy("doc_id", "size", "text_crc32", "grp").agg(F.count(F.lit(1)).alias("n")), "sized")
    groups = sized.groupBy("grp").agg(
        F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    groups = written(groups.sortWithinPartitions("grp"), "groups")
    firsts, rows_before, _ = smallest_capacity(groups, shards)

    total = groups.agg(F.sum("rows")).first()[0] or 0
    big = (F.col("rows") * HEAVY > total) & (F.col("rows") > HEAVY)
    large = sorted(r[0] for r in groups.where(big).select("grp").collect())  # under HEAVY
    # A cell is (prefix, rank, salt) in the order of the keys: the rank tells large groups from
    # what stands before, between and after them, and the salt deals out their rows.
    rank = F.lit(0)
    for g in large:
        rank = rank + (F.col("grp") >= g).cast("int") + (F.col("grp") > g).cast("int")
    # Equal rows come with their number; many of one key go to all cells in portions.
    often = F.col("grp").isin(large) & (F.col("n") > HEAVY)
    portions = F.when(often, F.lit(HEAVY)).otherwise(F.lit(1))
    dealt = sized.select("*", portions.alias("portions"),
                         F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))
    dealt = dealt.withColumn("n", F.expr("(n + portions - 1 - portion) div portions"))
    first = F.pmod(F.xxhash64("doc_id"), F.lit(HEAVY))
    salt = F.when(F.col("grp").isin(large), F.pmod(first + F.col("portion"), F.lit(HEAVY)))
    cells = dealt.withColumns({
        "p": F.substring("grp", 1, FIRST), "r": rank,
        "c": F.coalesce(salt, F.lit(0)).cast("int"),
    })
    starts, before = [], 0
    for p, r, c, n in sorted(
            tuple(x) for x in cells.groupBy("p", "r", "c").agg(F.sum("n")).collect()):
        starts.append((p, r, c, before))
        before += n
    # At most 16^FIRST prefixes and HEAVY cells for each large group.
    offsets = docs.sparkSession.createDataFrame(starts, "p string, r int, c int, start long")
    placed = cells.join(F.broadcast(offsets), ["p", "r", "c"])
    order = Window.partitionBy("p", "r", "c").orderBy("grp", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    until = F.col("start") + F.sum("n").over(order)
    placed = placed.withColumn("until", until).withColumn(
        "at", F.explode(F.sequence(F.col("until") - F.col("n"), F.col("until") - 1)))
    number, base = F.lit(-1), F.lit(0).cast("long")
    for i, (first, rows) in enumerate(zip(firsts, rows_before, strict=True)):
        number = number + (F.col("grp") >= first).cast("int")
        base = F.when(F.col("grp") >= first, F.lit(rows).cast("long")).otherwise(base)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        number.cast("int").alias("shard"), (F.col("at") - base).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
