"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import fresh, in_tasks, named, written
from postpulse.llm.components import components

BITS = 64
SEED = 42
_PART = 1 << 16  # shingles hashed at a time
CROWDED = 512  # fingerprints in a bucket beyond which the bucket is split by a second covering


def fingerprint(text: bytes | None, words: int) -> int:
    """Majority bits of the XXH64 of all runs of ``words`` words, repeats included."""
    tokens = (text or b"").lower().split()  # bytes: A-Z, and [\x20\x09-\x0D] as separators
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _PART):
        spans = zip(starts[i: i + _PART].tolist(), ends[i: i + _PART].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(v.as_py(), words) for v in batch.column(1)]
        prints = np.array(found, np.uint64).view(np.int64)
        kept = [batch.column(0), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(prints)], [batch.schema.names[0], *batch.schema.names[2:], "fp"])


def covering(radius: int, places: list[int]) -> list[int]:
    """Masks over the bit ``places``: two numbers that differ in at most ``radius`` of them agree
    under some mask.

    Place i gets the (radius + 1)-bit vector i mod (2^(radius + 1) - 1) + 1. The mask of a vector
    v holds the places whose vector has an odd product with v. For any ``radius`` vectors some v
    other than zero is even with all, so its mask leaves out all the places that differ.
    """
    vectors = 2 ** (radius + 1)
    return [
        sum(1 << p for i, p in enumerate(places) if (i % (vectors - 1) + 1 & v).bit_count() % 2)
        for v in range(1, vectors)
    ]


def tables(radius: int, depth: int) -> list[int]:
    """Masks of the first covering, or of a covering of what each of them leaves out."""
    masks = covering(radius, list(range(BITS)))
    for _ in range(depth):
        masks = [m | more for m in masks
                 for more in covering(radius, [p for p in range(BITS) if not m >> p & 1])]
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each bucket's fingerprints, linked to the smallest of their component in the bucket."""
    for batch in batches:
        ends: list[tuple[int, int]] = []
        for bucket in batch.column(0):
            prints = np.unique(np.array(bucket.as_py(), np.int64))
            bits = prints.view(np.uint64)  # bits of a negative number would be those of its amount
            pairs = []
            for i in range(0, len(prints), 256):
                far = np.bitwise_count(bits[i: i + 256, None] ^ bits[None, :])
                a, b = np.nonzero(far <= radius)
                pairs.append(np.stack([a + i, b]))
            a, b = np.concatenate(pairs, axis=1)
            label = np.arange(len(prints))
            while True:
                new = label.copy()
                np.minimum.at(new, a, label[b])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.nonzero(label != np.arange(len(prints)))[0]
            ends += zip(prints[moved].tolist(), prints[label[moved]].tolist(), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], ["a", "b"])


def links(prints: DataFrame, radius: int, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``radius`` bits.

    A bucket holds the fingerprints that agree under one mask; within it, only a link to the
    smallest of each component is made, never all pairs. A bucket of over ``crowded``
    fingerprints is split exactly, by the coverings of the bits its mask leaves out; after two
    splits (radius 2) only four to six free bits remain, so buckets are bounded by that.
    """
    found, left, depth = [], prints.select("fp"), 0
    while True:
        masks = F.array(*[F.lit(_signed(m)) for m in tables(radius, depth)])
        keyed = left.select("fp", F.posexplode(masks).alias("t", "mask")).select(
            "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        counts = keyed.groupBy("t", "key").count().where(F.col("count") > 1)
        met = keyed.join(counts, ["t", "key"])
        last = depth == 2
        small = met if last else met.where(F.col("count") <= crowded)
        lists = small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(in_tasks(lists, partial(_bucket_links, radius=radius), "a long, b long"))
        if last:
            break
        left = written(met.where(F.col("count") > crowded).select("fp").distinct(), "crowded")
        if left.isEmpty():
            break
        depth += 1
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id",
                text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """Fingerprint and component of every document.

    Lower-cases A-Z, takes words ``[^\\x20\\x09-\\x0D]+`` and all runs of ``words`` words (the whole
    sequence if there are fewer). Documents without words, null texts too, have fingerprint zero,
    linked like any other. Fingerprints that differ in at most ``radius`` bits are linked.

    Output: doc_id, fingerprint (16 hex digits), component_id (the smallest key reachable; null
    keys count only where no other is in the component); one row per row of ``docs``, repeated rows
    included. Other columns aren't read. An empty table gives an empty one.

    Equal fingerprints are one node from the start, so a hot group of copies is one row in
    the tables. Documents meet their component in a join on the fingerprint.
    """
    rows = docs.select(named(key).cast("long").alias("id"),
                       named(text).cast("binary").alias("text"))
    each = written(in_tasks(rows, partial(_fingerprints, words=words), "id long, fp long"), "prints")
    nodes = each.groupBy("fp").agg(F.min("id").alias("first"))
    known = _rooted(nodes, radius, crowded)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named_nodes = known.join(least, "root").select("fp", "component_id")
    return each.join(named_nodes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def _rooted(nodes: DataFrame, radius: int, crowded: int) -> DataFrame:
    """Fingerprints ``fp`` with ``first`` and the root of their component."""
    roots = components(links(nodes, radius, crowded))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_first(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id",
               text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row of each component, with all its columns.

    That of the smallest key, a null key last; of several texts of one key, in a component, the one
    of the smallest digest; rows equal in key and text become one. So each component keeps exactly
    one row, whatever keys are null or repeated. Null texts are empty ones. An empty table gives an
    empty one; other columns keep their names and values.
    """
    mark = F.sha2(F.coalesce(named(text).cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.select(named(key).cast("long").alias("id"), named(text).cast("binary").alias("text"),
                       mark.alias("mark"))
    each = written(in_tasks(rows, partial(_fingerprints, words=words),
                            "id long, mark string, fp long"), "prints")
    own = F.struct(F.col("id").isNull().alias("z"), "id", "mark")
    known = _rooted(each.groupBy("fp").agg(F.min(own).alias("first")), radius, crowded)
    best = known.groupBy("root").agg(F.min("first").alias("first"))
    who, what = fresh(docs, "_who"), fresh(docs, "_what")
    text_key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = best.select(text_key(F.col("first.id")).alias(who), F.col("first.mark").alias(what))
    marked = docs.withColumns({who: text_key(named(key).cast("long")), what: mark})
    met = marked.join(first, [who, what], "left_semi")
    return met.dropDuplicates([who, what]).select(*map(named, docs.columns))
