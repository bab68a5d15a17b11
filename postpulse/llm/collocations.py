"""Phrase collocations from a weighted de Bruijn graph of words."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.common import in_tasks, joined_bytes, named, slices, written
from postpulse.llm.words import PRIME, Words, mixed

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of an edge of the graph
MOST_SLOTS = 29  # log2 of the most counters; their bits take 64 MB
PART = 16  # log2 of the counters in one row
SPLIT = 256  # edges of a path in one row
SALT = 64  # portions in which a language's candidates are first ranked
OWNERS = 4096  # portions in which runs of words are put together
_HELD = 1 << 22  # slots that a task holds before it hands them on
_RUNS = 500_000  # runs that a task holds

# Bytes as they count: A-Z in lower case, ends of pieces as a line break, tab as a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[10, 11, 12, 13, *b".,;:!?"]] = 10
FOLD[9] = 32


class Pieces:
    """The words of some texts, and which of them follow each other within a piece."""

    def __init__(self, langs: list[str], data: np.ndarray, ends: np.ndarray):
        self.langs = sorted(set(langs))
        self.data = FOLD[data]
        self.words = Words(self.data, ends)
        code = {name: i for i, name in enumerate(self.langs)}
        own = np.array([code[x] for x in langs], np.int64)
        self.text = np.repeat(np.arange(len(langs)), self.words.count)
        self.lang = own[self.text]
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(self.data == 10, out=breaks[1:])
        w = self.words
        self.joined = np.zeros(len(w.starts), bool)  # with the next word
        self.joined[:-1] = (breaks[w.ends[:-1]] == breaks[w.starts[1:]]) \
            & (self.text[:-1] == self.text[1:])
        self.hashes = w.hashes()

    def short(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of every word; words that are joined with the next one, and the slot of each pair."""
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)
        own = self.hashes + seeds[self.lang]
        at = np.nonzero(self.joined)[0]
        self.begun = np.zeros(len(self.joined), np.uint64)
        self.begun[at] = mixed(own[at] * np.uint64(PRIME) + self.hashes[at + 1])
        down = np.uint64(64 - bits)
        return mixed(own) >> down, at, self.begun[at] >> down

    def longer(self, bits: int, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 3 to LONGEST words: the words at which that many follow along ``live`` pairs (first
        words), and the slot of each such run. Positions sent in take part in the next length."""
        go = np.zeros(len(self.joined) + LONGEST, bool)
        go[live] = True
        at, h = np.nonzero(go)[0], self.begun
        code = h[at]
        for k in range(1, LONGEST - 1):
            on = go[at + k]
            at = at[on]
            code = mixed(code[on] * np.uint64(PRIME) + self.hashes[at + k + 1])
            passed = yield at, code >> np.uint64(64 - bits)
            if passed is not None:
                at, code = at[passed], code[passed]

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the words ``at``, equal for equal words only; 0 for the others."""
        w, width = self.words, 24
        out = np.zeros(len(self.text) + LONGEST, np.int64)
        _, first, ids = np.unique(self.hashes[at], return_index=True, return_inverse=True)
        starts, ends = w.starts[at], w.ends[at]
        size, like = ends - starts, first[ids]
        padded = np.concatenate([self.data, np.zeros(width, np.uint8)])
        heads = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
        heads[np.arange(width) >= size[:, None]] = 0
        heads = heads.view(np.uint64)
        same = bool((size == size[like]).all() and (heads == heads[like]).all())
        raw = self.data.tobytes()
        long = np.nonzero((size > width) & (like != np.arange(len(like))))[0] if same else []
        for i in long:
            a, b = starts[i], starts[like[i]]
            if raw[a: ends[i]] != raw[b: b + size[i]]:
                same = False
                break
        if not same:  # two words with one hash
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(raw[a:b], len(known))
                            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        out[at] = ids + 1
        return out

    def longest(self, words: np.ndarray, reach: np.ndarray
                ) -> tuple[list[str], list[str], list[int], list[int]]:
        """(lang, words, number of words, count) of the runs from ``words`` over ``reach`` more."""
        w, ids = self.words, self.ids(words)
        reach = reach[words]
        columns = [self.lang[words], ids[words]]
        columns += [np.where(reach >= k, ids[words + k], 0) for k in range(1, LONGEST)]
        order = np.lexsort(columns[::-1])
        changed = np.zeros(len(words), bool)
        changed[:1] = True
        for c in columns:
            c = c[order]
            changed[1:] |= c[1:] != c[:-1]
        starts = np.nonzero(changed)[0]
        count = np.diff(np.append(starts, len(words)))
        at, size = words[order[starts]], reach[order[starts]] + 1
        raw = self.data.tobytes()
        spans = zip(w.starts[at].tolist(), w.ends[at + size - 1].tolist(), strict=True)
        texts = [b" ".join(raw[a:b].split()).decode("utf-8", "replace") for a, b in spans]
        return [self.langs[k] for k in self.lang[at]], texts, size.tolist(), count.tolist()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in slices(batches, "text"):
        data, ends = joined_bytes(batch.column(1))
        yield Pieces(batch.column(0).to_pylist(), data, ends)


def _hit(known: np.ndarray, slot: np.ndarray) -> np.ndarray:
    place = known[(slot >> np.uint64(3)).astype(np.int64)]
    return place >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def _slot_counts(batches: Iterator[pa.RecordBatch], bits: int, least: int, pairs
                 ) -> Iterator[pa.RecordBatch]:
    """Counts by slot, cut to ``least``, as rows of (part, places in it, counts).

    Of pairs; or, with the frequent ones known, of the words in them and the longer runs along them.
    """
    kind = np.min_scalar_type(least)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        slots, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        total = np.bincount(where, np.concatenate([h[1] for h in held]), len(slots))
        return slots, np.minimum(total, least).astype(np.int64)

    def rows(slots, counts):
        part = (slots >> np.uint64(PART)).astype(np.int64)
        cuts = np.nonzero(np.diff(part, prepend=-1))[0]
        places = (slots & np.uint64((1 << PART) - 1)).astype("<u2")
        ends = np.append(cuts[1:], len(slots))
        return pa.RecordBatch.from_arrays([
            pa.array(part[cuts]),
            pa.array([places[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([counts[a:b].astype(kind).tobytes() for a, b in zip(cuts, ends, strict=True)],
                     pa.binary()),
        ], ["part", "places", "counts"])

    size = 0
    for pieces in _pieces(batches):
        word, at, slot = pieces.short(bits)
        if pairs is not None:
            live = at[_hit(pairs.value, slot)]
            runs = pieces.longer(bits, live)
            slot = np.concatenate([word[live], word[live + 1], *(found for _, found in runs)])
        if not len(slot):
            continue
        held.append(np.unique(slot, return_counts=True))
        size += len(held[-1][0])
        if size > _HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield rows(*held.pop())
                size = 0
    if held:
        yield rows(*merged())


def _live_parts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A bit for every slot whose counts come to ``least``."""
    kind = np.min_scalar_type(least)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = sums.setdefault(part, np.zeros(1 << PART, np.int64))
            total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()),
         pa.array([np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()],
                  pa.binary())], ["part", "bits"])


def slot_bits(texts: DataFrame, most: int = MOST_SLOTS) -> int:
    """log2 of the counters: one for 16 bytes of text, 2^``most`` at most.

    Beyond that more runs pass, which costs time and changes no result.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(math.ceil(math.log2(size / 16 + 1)), PART), most)


def frequent_slots(texts: DataFrame, bits: int, least: int, pairs=None) -> np.ndarray:
    """The slots, as bits, of all pairs that may come ``least`` times; or, with those known, of the words
    in them and of all runs of three to five words along them that may.

    Every run counts in the slot of its hash; slots that stay under ``least`` hold no frequent one.
    """
    counted = in_tasks(texts, partial(_slot_counts, bits=bits, least=least, pairs=pairs),
                       "part long, places binary, counts binary")
    parts = in_tasks(counted.repartition("part"), partial(_live_parts, least=least),
                     "part long, bits binary")
    live = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << PART) // 8
    for part, found in parts.collect():  # 2^(MOST_SLOTS - 3) bytes at most
        live[part * step: (part + 1) * step] = np.frombuffer(found, np.uint8)
    return live


def _longest_grams(batches: Iterator[pa.RecordBatch], bits: int, pairs, runs
                   ) -> Iterator[pa.RecordBatch]:
    """Counts of the longest runs, added up over a task: rows of (part, langs, grams, counts)."""
    held: Counter = Counter()

    def rows():
        parts: dict[int, tuple[list, list, list]] = {}
        for (lang, gram), n in held.items():
            part = zlib.crc32(f"{lang}:{gram}".encode("utf-8", "replace")) % OWNERS
            for column, x in zip(parts.setdefault(part, ([], [], [])), (lang, gram, n), strict=True):
                column.append(x)
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int64()),
             *(pa.array([p[i] for p in parts.values()], pa.list_(k)) for i, k in enumerate(kinds))],
            ["part", "langs", "grams", "counts"])

    for pieces in _pieces(batches):
        word, at, slot = pieces.short(bits)
        live = at[_hit(pairs.value, slot)]
        reach = np.zeros(len(pieces.text), np.int64)
        reach[live] = 1
        steps = pieces.longer(bits, live)
        passed = None
        while True:
            try:
                at, slot = steps.send(passed)
            except StopIteration:
                break
            passed = _hit(runs.value, slot)
            reach[at[passed]] += 1
        lang, gram, _, count = pieces.longest(np.nonzero(_hit(runs.value, word))[0], reach)
        for key, n in zip(zip(lang, gram, strict=True), count, strict=True):
            held[key] += n
        for k, n in enumerate(np.bincount(pieces.lang, minlength=len(pieces.langs)).tolist()):
            held[pieces.langs[k], ""] += n
        if len(held) > _RUNS:
            yield rows()
            held.clear()
    yield rows()


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: the counts of each are added up and handed on."""
    at, sums = None, Counter()

    def found():
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
             pa.array([k[1].count(" ") + 1 if k[1] else 0 for k in sums], pa.int32()),
             pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "size", "n"])

    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != at:
                if sums:
                    yield found()
                at, sums = part, Counter()
            langs, grams, counts = (batch.column(c)[i].as_py() for c in (1, 2, 3))
            for lang, gram, n in zip(langs, grams, counts, strict=True):
                sums[lang, gram] += n
    yield found()


def longest_grams(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang"
                  ) -> DataFrame:
    """Edges of the graph and ends of pieces: (lang, gram, size, n); size 0 counts all words.

    From every word that stands in a pair that may be frequent, the longest run of up to five words that
    may be frequent, within its piece, is one count. Runs of five are edges, from the node of their first four words to the node of their
    last four; shorter ones are ends. What begins a frequent phrase is frequent too, so each
    occurrence of a phrase that comes ``least`` times is the beginning of exactly one such run.
    Counters tell in two passes what may be frequent: pairs, then longer runs along them. Words of no
    such pair are part of no frequent phrase and count in the language's total only.
    """
    texts = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(named(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    bits, share = slot_bits(texts), docs.sparkSession.sparkContext.broadcast
    pairs = share(frequent_slots(texts, bits, least))
    runs = share(frequent_slots(texts, bits, least, pairs))
    counted = in_tasks(texts, partial(_longest_grams, bits=bits, pairs=pairs, runs=runs),
                       "part long, langs array<string>, grams array<string>, counts array<long>")
    owned = counted.repartition("part").sortWithinPartitions("part")
    return in_tasks(owned, _put_together, "lang string, gram string, size int, n long")


def _first(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def unary_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Paths without branches, each as one row: (lang, words, edges, n); all edges are in one.

    A node is unary if one edge comes in and one goes out, with equal flow, and no piece ends there
    (nor begins, as the flows are equal). Edges point to the next one behind a unary node; pointers
    are doubled until all point to the last edge of their path. A circle of unary nodes can't be:
    pieces begin and end, so flow comes in and goes out somewhere. Long paths are cut into rows of
    SPLIT edges that overlap in a node.
    """
    nodes = edges.select("lang", "gram", "n", _first("gram", LONGEST - 1).alias("head"),
                         _first("gram", 1 - LONGEST).alias("tail"))
    out = nodes.groupBy("lang", F.col("head").alias("node")).agg(
        F.count(F.lit(1)).alias("outs"), F.sum("n").alias("flow"), F.max("gram").alias("next"))
    into = nodes.groupBy("lang", F.col("tail").alias("node")).agg(
        F.count(F.lit(1)).alias("ins"), F.sum("n").alias("came"))
    stops = ends.where(F.col("size") == LONGEST - 1).select("lang", F.col("gram").alias("node"))
    unary = out.where("outs = 1").join(into.where("ins = 1"), ["lang", "node"]).where(
        "flow = came").join(stops, ["lang", "node"], "left_anti")
    links = written(nodes.join(unary.select("lang", F.col("node").alias("tail"), "next"),
                               ["lang", "tail"], "left").select("lang", "gram", "n", "next"), "edges")
    moving = links.where(F.col("next").isNotNull()).select(
        "lang", "gram", "next", F.lit(1).cast("long").alias("far"))
    moving = written(moving, "pointers")
    ahead = lambda: moving.select("lang", F.col("gram").alias("next"),
                                  F.col("next").alias("beyond"), F.col("far").alias("step"))
    while not moving.join(ahead(), ["lang", "next"], "left_semi").isEmpty():
        moving = written(moving.join(ahead(), ["lang", "next"], "left").select(
            "lang", "gram", F.coalesce("beyond", "next").alias("next"),
            (F.col("far") + F.coalesce("step", F.lit(0))).alias("far")), "pointers")
    placed = links.drop("next").join(moving, ["lang", "gram"], "left").select(
        "lang", "n", "gram", F.coalesce("next", "gram").alias("path"),
        F.coalesce("far", F.lit(0)).alias("far"))
    rows = placed.groupBy("lang", "path", (F.col("far") / SPLIT).cast("long").alias("row")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("far", "gram")), False).alias("run"))
    last = F.transform(F.slice("run", F.lit(2), F.size("run")), lambda e: _first(e["gram"], -1))
    return rows.select("lang", F.array_join(
        F.concat(F.array(F.col("run")[0]["gram"]), last), " ").alias("words"),
        F.size("run").alias("edges"), "n")


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang"
                  ) -> DataFrame:
    """Occurrences of every phrase of 2 to 5 words that comes ``least`` times and of the words in them:
    (lang, phrase, size, f). Size 0: the empty phrase, all words of the language.

    A phrase's count is the flow of the runs that begin with it: edges along the paths, and ends
    of pieces for what no edge covers.
    """
    grams = written(longest_grams(docs, least, text, lang), "grams")
    ends = grams.where(F.col("size") < LONGEST)
    paths = unary_paths(grams.where(F.col("size") == LONGEST), ends)
    runs = paths.union(ends.where("size > 0").select("lang", "gram", F.lit(1), "n"))
    words = F.split("words", " ")
    starts = runs.select("lang", "n", words.alias("w"), F.explode(
        F.sequence(F.lit(1), F.col("edges"))).alias("at"))
    most = F.least(F.lit(LONGEST), F.size("w") - F.col("at") + 1)
    begun = starts.select("lang", "n", "w", "at", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    counts = begun.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias(
        "phrase"), "size").agg(F.sum("n").alias("f"))
    total = grams.where("size = 0").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("f"))
    return counts.where(F.col("f") >= least).union(total)


def top_phrases(docs: DataFrame, least: int = LEAST, cover: int = 100, top: int = 2000,
                text: str = "text", lang: str = "lang") -> DataFrame:
    """The best collocations of each language.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words
    ``[^\\x20\\x09]+``. Candidates are phrases of 2 to 5 words with a >= ``least`` occurrences. A
    cut gives l and r, the counts of both sides, and floor(1000 * a * n / (l * r)), n all words of the
    language; the least cut counts, the shortest first part on ties. Candidates that
    stand inside a longer one with 100 * f >= ``cover`` * a are dropped. The best ``top`` by score,
    count and phrase (bytes) stay.

    Output: lang, rank from 1, phrase, a, l, r, n, score, left (words of the first part). Null lang:
    ``und``; null text: no words. Rows with equal texts, null or equal keys all count; an empty table
    gives an empty one. Only ``text`` and ``lang`` are read, whatever other columns are called.

    Products are decimals of 38 digits. A language's candidates are ranked in portions first, so
    what one task ranks at the end doesn't grow with them.
    """
    counts = written(phrase_counts(docs, least, text, lang), "phrases")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.where(f"size > 1 AND f >= {least}").withColumn("w", F.split("phrase", " "))
    longer = candidates.where("size > 2").select("lang", "w", "size", "f")
    inside = longer.select("lang", "f", "size", "w", F.explode(
        F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inside = inside.select("lang", "f", "w", "k", F.explode(
        F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    held = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias(
        "phrase")).agg(F.max("f").alias("held"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(
        F.col("held").isNull() | (100 * F.col("held") < cover * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(
        F.sequence(F.lit(1), F.col("size") - 1)).alias("left"))
    part = lambda name: counts.select("lang", F.col("phrase").alias(f"{name}_part"),
                                      F.col("f").alias(name))
    met = cuts.select(
        "lang", "phrase", "a", "left", F.array_join(F.slice("w", F.lit(1), F.col("left")), " ").alias("l_part"),
        F.array_join(F.slice("w", F.col("left") + 1, F.col("size")), " ").alias("r_part"),
    ).join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"]).join(
        F.broadcast(total), "lang")  # one row for each language
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = met.withColumn("up", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")) \
        .withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "left", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    first = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left")
