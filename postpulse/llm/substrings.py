"""Substring dedup: repeated runs of words, found by FM-indexes over shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import in_tasks, joined_bytes, named, slices, written
from postpulse.llm.fm_index import FMIndex
from postpulse.llm.words import PRIME, Words, mixed

WORDS = 20  # words of a window
ANCHOR = 6  # words of the runs of which each window's smallest hash is its anchor
HOT = 4096  # occurrences of an anchor beyond which its windows go to shards one by one
SHARD = 1 << 19  # words in an index, about
_SLICE = 2 << 20
_HELD = 16 << 20
HEAVY = 256  # a row repeated more often is worked through once, for so many of the most frequent


def _packed(start, many):
    """First window and number of windows as one long."""
    return start << 8 | many


def _unpacked(value: int) -> tuple[int, int]:
    return value >> 8, value & 255


def anchors(words: Words, length: int, run: int) -> tuple[np.ndarray, ...]:
    """(hash, text, first window, windows) of each stretch of windows with the same anchor.

    A window's anchor is the leftmost of its runs of ``run`` words with the smallest hash, so equal
    windows have equal anchors at the same place, wherever they stand.
    """
    hashes = words.hashes()
    n = len(hashes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    runs = np.zeros(len(hashes) - run + 1, np.uint64)
    for k in range(run):
        runs = runs * np.uint64(PRIME) + hashes[k: k + len(runs)]
    runs = mixed(runs)
    # Leftmost smallest over `span` neighbours, by doubling.
    span = length - run + 1
    least, where, have = runs, np.arange(len(runs), dtype=np.int32), 1
    while have < span:
        step = min(have, span - have)
        left, right = least[: len(least) - step], least[step:]
        take = right < left
        where = np.where(take, where[step:], where[: len(left)])
        least = np.where(take, right, left)
        have += step
    windows = np.maximum(words.count - length + 1, 0)
    owner = np.repeat(np.arange(words.texts), windows)
    before = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) - np.repeat(before - words.first, windows)
    place = where[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.nonzero(new)[0]
    many = np.diff(np.concatenate([first, [len(at)]]))
    return least[at[first]], owner[first], at[first] - words.first[owner[first]], many


_PLACE = pa.struct([("doc", pa.int64()), ("mark", pa.int64()), ("stretch", pa.int64())])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, run: int
                 ) -> Iterator[pa.RecordBatch]:
    """One row for each anchor of a slice: its first place, and a list of the others if any."""
    for batch in slices(batches, "text", _SLICE):
        found, owner, first, many = anchors(Words(*joined_bytes(batch.column(2))), length, run)
        order = np.argsort(found, kind="stable")
        found, owner = found[order], owner[order]
        doc, mark = (batch.column(i).to_numpy()[owner] for i in (0, 1))
        stretch = _packed(first[order], many[order])
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        heads = np.nonzero(new)[0]
        others = np.diff(np.concatenate([heads, [len(found)]])) - 1
        ends = np.concatenate([[0], np.cumsum(others)]).astype(np.int32)
        rest = pa.StructArray.from_arrays(
            [pa.array(c[~new]) for c in (doc, mark, stretch)], fields=list(_PLACE))
        lists = pa.ListArray.from_arrays(pa.array(ends), rest, mask=pa.array(others == 0)) \
            if len(heads) else pa.array([], pa.list_(_PLACE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[heads].view(np.int64)),
             *(pa.array(c[heads]) for c in (doc, mark, stretch)), lists],
            ["anchor", "doc", "mark", "stretch", "more"])


def _anchor_counts(batches: Iterator[pa.RecordBatch], length: int, run: int
                   ) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        found, n = np.unique(anchors(Words(*joined_bytes(batch.column(0))), length, run)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words under each stretch of windows that may repeat; equal ones of a task come once, as
    far as ``_HELD`` bytes of them reach."""
    found: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int64()),
             pa.array([k[1] for k in found], pa.binary()),
             *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(3))],
            ["shard", "words", "doc", "mark", "at"])

    for batch in slices(batches, "text", _SLICE):
        words = Words(*joined_bytes(batch.column(2)))
        keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))
        whole = words.data.tobytes()
        starts, ends = words.starts.tolist(), words.ends.tolist()
        for i, met in enumerate(batch.column(3)):
            first = int(words.first[i])
            for stretch in met.as_py() or ():
                start, many = _unpacked(stretch["stretch"])
                spots = range(start, start + many) if stretch["hot"] else (start,)
                take = length if stretch["hot"] else length + many - 1
                for at in spots:
                    a = first + at
                    text = b" ".join([whole[s:e] for s, e in
                                      zip(starts[a: a + take], ends[a: a + take], strict=True)])
                    shard = int.from_bytes(sha256(text).digest()[:8], "little", signed=True) \
                        if stretch["hot"] else stretch["anchor"]
                    place, here = (shard, text), (*keys[i], _packed(at, 0))
                    known = found.get(place)
                    if known is None:
                        held += len(text)
                    if known is None or here < known:
                        found[place] = here
        if held > _HELD:
            yield flush()
            found.clear()
            held = 0
    if found:
        yield flush()


def _first_windows(rows: list[tuple[bytes, int, int, int]], length: int
                   ) -> list[tuple[int, int, int]]:
    """The stretches of windows that are the first of their kind, as key, text hash and packed place,
    of contexts given as words, key, text hash and packed place of the first window."""
    rows.sort(key=lambda r: r[1:])
    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number) + 1) for w in r[0].split(b" ")] for r in rows]
    sizes = np.array([len(t) for t in texts])
    # Symbol 0 parts the contexts.
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = np.concatenate([np.array(t) for t in texts])
    many = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    spots = begin[owner] + offset
    low, _ = FMIndex(text, length).search(text, spots, length)
    # Contexts are streamed in corpus order: the first window to report an interval is the first.
    fresh = low < 0
    seen = np.nonzero(~fresh)[0]
    fresh[seen[np.unique(low[seen], return_index=True)[1]]] = True
    out = []
    start = np.ones(len(owner), bool)
    start[1:] = (owner[1:] != owner[:-1]) | (fresh[1:] != fresh[:-1])
    edges = np.nonzero(start)[0]
    runs = np.diff(np.concatenate([edges, [len(owner)]]))
    for e, n in zip(edges[fresh[edges]].tolist(), runs[fresh[edges]].tolist(), strict=True):
        _, doc, mark, at = rows[owner[e]]
        out.append((doc, mark, at + (int(offset[e]) << 8) + n))
    return out


def _search(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard key; whole keys are gathered to an index of about ``size`` words.

    Of equal contexts only the first in the corpus matters, so each is indexed once.
    """
    found: dict[bytes, tuple[int, int, int]] = {}
    held, last = 0, None

    def flush() -> pa.RecordBatch:
        kept = _first_windows([(text, *place) for text, place in found.items()], length)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in kept], pa.int64()) for i in range(3)], ["doc", "mark", "kept"])

    for batch in batches:
        for shard, text, *here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held > size and shard != last:
                yield flush()
                found, held = {}, 0
            here, known = tuple(here), found.get(text)
            if known is None:
                held += text.count(b" ") + 2
            if known is None or here < known:
                found[text] = here
            last = shard
    if found:
        yield flush()


def _cleaned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words of repeated windows, given the stretches that may repeat and the
    windows among them that stay."""
    for batch in slices(batches, "text", _SLICE):
        words = Words(*joined_bytes(batch.column(2)))
        whole = words.data.tobytes()
        gone_of, digest, texts = [], [], []
        for i in range(batch.num_rows):
            n, first = int(words.count[i]), int(words.first[i])
            edges = np.zeros(n + 1, np.int64)
            again = np.zeros(n + 1, bool)
            for stretch in batch.column(3)[i].as_py() or ():
                start, many = _unpacked(stretch)
                again[start: start + many] = True
            for kept in batch.column(4)[i].as_py() or ():
                start, many = _unpacked(kept)
                again[start: start + many] = False
            at = np.nonzero(again)[0]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + length, -1)
            stay = np.nonzero(np.cumsum(edges)[:n] == 0)[0] + first
            spans = zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)
            text = b" ".join([whole[s:e] for s, e in spans])
            gone_of.append(n - len(stay))
            digest.append(sha256(text).hexdigest())
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)),
             pa.array(gone_of, pa.int64()), pa.array(digest, pa.string()),
             pa.array(texts, pa.binary())],
            ["doc", "mark", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each key and text hash."""
    met = set()
    for batch in batches:
        first = []
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)):
            if row not in met:
                met.add(row)
                first.append(i)
        if first:
            yield batch.take(pa.array(first))


def _heavy(rows: DataFrame, heavy: int) -> DataFrame | None:
    """(doc, mark, n): the ``heavy`` most frequent rows of those that come more than ``heavy`` times.

    Any other row is less than one in ``heavy`` of all.
    """
    counts = rows.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") > heavy).orderBy(F.desc("n"), "doc", "mark").limit(heavy)
    found = [tuple(r) for r in most.collect()]
    return rows.sparkSession.createDataFrame(found, "doc long, mark long, n long") if found else None


def _multiplied(clean: DataFrame, often: DataFrame, heavy: int) -> DataFrame:
    """The rows in ``often`` as many times as it says, dealt out in ``heavy`` portions each."""
    clean, by = written(clean, "clean"), ["doc", "mark"]
    portion = F.explode(F.sequence(F.lit(0), F.lit(heavy - 1))).alias("portion")
    dealt = clean.join(F.broadcast(often), by).select("*", portion).repartition(*by, "portion")
    # Portions differ by one at most; each has a row, as n is over `heavy`.
    many = F.expr(f"(n + {heavy - 1} - portion) div {heavy}")
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), many)))
    return clean.join(F.broadcast(often), by, "left_anti").unionByName(copies.select(clean.columns))


def remove_repeats(docs: DataFrame, length: int = WORDS, anchor: int = ANCHOR, hot: int = HOT,
                   shard: int = SHARD, key: str = "doc_id", text: str = "text",
                   heavy: int = HEAVY) -> DataFrame:
    """Every document without the words of windows that also start earlier in the corpus.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``length`` consecutive words of one
    document. A word goes if a window over it has a copy that starts earlier: in a document of a
    smaller key, or earlier in the same one. Windows are judged on the input.

    Output: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by one space). Null
    text has no words; fewer than ``length`` words stay whole. Repeated rows keep the same words;
    rows of one key with different texts come in the order of a text hash. A null key is put
    before all others. An empty table gives an empty one. Other columns aren't read.

    1. Each window gets an anchor, a run of ``anchor`` words chosen by content, so equal windows
       share it. Anchors are counted; only stretches of windows whose anchor occurs again go on.
    2. These stretches go to shards by anchor, equal ones of a batch once. Those of an anchor with
       over ``hot`` occurrences go window by window, by the hash of the whole window, so
       no anchor is gathered in one shard.
    3. A task builds FM-indexes of about ``shard`` words over its shards and streams the stretches
       against them in corpus order. Backward search over the wavelet tree gives each window's
       interval; the first to report an interval of more than one row stays, the rest are repeats.
    4. Each document gets its stretches and the windows that stay back.

    The hash only chooses what is compared; windows are compared word by word. Rows are known by key
    and 64 bits of a text hash, so a null or repeated key gathers nothing. A row repeated more than
    ``heavy`` times is worked through once and multiplied at the end, if it is among the ``heavy``
    most frequent ones.
    """
    rows = docs.select(F.coalesce(named(key), F.lit(-(1 << 63))).cast("long").alias("doc"),
                       F.xxhash64(named(text).cast("binary")).alias("mark"),
                       named(text).cast("binary").alias("text"))
    by = ["doc", "mark"]
    often = _heavy(rows, heavy)
    if often:
        once = in_tasks(rows.join(F.broadcast(often.select(by)), by, "left_semi"), _one_each,
                        "doc long, mark long, text binary").dropDuplicates(by)
        rows = rows.join(F.broadcast(often.select(by)), by, "left_anti").unionByName(
            written(once, "heavy"))
    counted = in_tasks(rows.select("text"), partial(_anchor_counts, length=length, run=anchor),
                       "anchor long, n int")
    again = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    stretches = in_tasks(rows, partial(_anchor_rows, length=length, run=anchor),
                         "anchor long, doc long, mark long, stretch long, "
                         "more array<struct<doc:long,mark:long,stretch:long>>")
    met = stretches.join(again.select("anchor", (F.col("n") > hot).alias("hot")), "anchor")
    # An anchor comes once from each slice of a task, so a hot one has few rows in the join.
    places = F.concat(F.array(F.struct(*by, "stretch")), F.coalesce("more", F.array()))
    met = met.select("anchor", "hot", F.inline(places))
    # A set: repeated rows give the same stretches.
    of_doc = met.groupBy(by).agg(F.collect_set(F.struct("anchor", "stretch", "hot")).alias("met"))
    joined = rows.join(of_doc, by).select(*by, "text", "met")
    contexts = in_tasks(joined, partial(_contexts, length=length),
                        "shard long, words binary, doc long, mark long, at long")
    dealt = contexts.repartition("shard").sortWithinPartitions("shard")
    kept = in_tasks(dealt, partial(_search, length=length, size=shard),
                    "doc long, mark long, kept long")
    of_kept = kept.groupBy(by).agg(F.collect_list("kept").alias("kept"))
    whole = rows.join(of_doc, by, "left").join(of_kept, by, "left").select(
        *by, "text", F.col("met.stretch").alias("met"), "kept")
    clean = in_tasks(whole, partial(_cleaned, length=length), "doc long, mark long, n_words long, "
                     "n_removed long, kept_sha256 string, kept_text binary")
    if often:
        clean = _multiplied(clean, often, heavy)
    return clean.select(F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "n_words",
                        "n_removed", "kept_sha256", F.col("kept_text").cast("string"))
