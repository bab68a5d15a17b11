"""Exact dedup by owners that hold texts in compressed radix tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import SPACES, fresh, in_tasks, named
from postpulse.llm.patricia import PatriciaTrie

TRIE_BYTES = 48 << 20  # memory of a trie in one task; beyond it subtrees are spilled
_LOCAL = "size long, sha string, data binary, chars long, id long, n long"
_OWNED = "sha string, chars long, id long, n long"
_ROWS = 500  # terminals in a batch that a task hands on


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null is empty."""
    strip = reduce(lambda c, s: F.replace(c, F.lit(chr(s))), SPACES, text)
    return F.coalesce(strip, F.lit(""))


def _candidate(chars: int, key: int | None) -> tuple:
    """Ordered so that the most characters, then the smallest key, come first; null keys last."""
    return -chars, key is None, key or 0


def _spilled(terminals, with_data: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
            schema=schema)

    held = 0
    for data, (chars, null, key), n in terminals:
        rest = (sha256(data).hexdigest(), -chars, None if null else key, n)
        rows.append((len(data), rest[0], data, *rest[1:]) if with_data else rest)
        held += len(data) * with_data
        if len(rows) >= _ROWS or held > 8 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _schema(with_data: bool) -> pa.Schema:
    kinds = [("sha", pa.string()), ("chars", pa.int64()), ("id", pa.int64()), ("n", pa.int64())]
    if with_data:
        kinds = [("size", pa.int64()), kinds[0], ("data", pa.binary()), *kinds[1:]]
    return pa.schema(kinds)


def _grow(batches: Iterator[pa.RecordBatch], limit: int, owner: bool) -> Iterator[pa.RecordBatch]:
    """Insert every row into a trie; hand on its terminals when it is full and at the end."""
    trie, schema = PatriciaTrie(), _schema(not owner)
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            data, chars, key, n = (c[i].as_py() for c in columns)
            if not owner:
                data = (data or b"").translate(None, SPACES)
            trie.insert(data, _candidate(chars, key), n)
            if trie.bytes > limit:
                yield from _spilled(trie.spill(limit // 2), not owner, schema)
    yield from _spilled(trie.terminals(), not owner, schema)


def text_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                limit: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size, chars (of the row that
    stays).

    Each task first inserts its own rows into a trie, so copies within it meet before any
    shuffle and a hot text leaves a task once. The terminals go to owners by length and content
    hash; an owner inserts the full byte strings into its trie. A trie over ``limit`` bytes hands
    on its largest subtrees; what is handed on twice is added up at the end by digest.
    """
    rows = docs.select(
        named(text).cast("binary").alias("data"),
        F.coalesce(F.char_length(named(text)), F.lit(0)).cast("long").alias("chars"),
        named(key).cast("long").alias("id"), F.lit(1).cast("long").alias("n"),
    )
    local = in_tasks(rows, partial(_grow, limit=limit, owner=False), _LOCAL)
    owned = local.repartition("size", "sha").select("data", "chars", "id", "n")
    met = in_tasks(owned, partial(_grow, limit=limit, owner=True), _OWNED)
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id"))
    return met.groupBy(F.col("sha").alias("text_sha256")).agg(
        best.alias("best"), F.sum("n").alias("group_size")
    ).select("text_sha256", F.col("best.id").alias("keep_id"), "group_size",
             (-F.col("best.c")).alias("chars"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 limit: int = TRIE_BYTES) -> DataFrame:
    """For every document, the one of its equal texts that stays.

    Texts are equal if they are without ``[\\x20\\x09-\\x0D]``; null counts as empty. The row with
    the most code points in the original text stays, then the smallest key; a null key stays only
    if no other is as long. Repeated rows count as copies and all carry the same marks.

    Output: doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``. Other
    columns are not read. An empty table gives an empty one. Documents meet their group in a
    join on the digest, whose hot keys adaptive execution splits.
    """
    each = docs.select(named(key).alias("doc_id"),
                       F.sha2(normalised(named(text)).cast("binary"), 256).alias("text_sha256"))
    met = each.join(text_groups(docs, key, text, limit), "text_sha256")
    return met.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text",
               limit: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one for each group of equal texts.

    Where several rows of a group have the key that stays, it is one of those with the longest text;
    rows that are equal in key, text and length become one. Null keys and null texts count as
    in ``exact_groups``. An empty table gives an empty one; other columns keep their names and values.
    """
    sha, who, size, most = (fresh(docs, n) for n in ("_sha", "_who", "_size", "_most"))
    text_key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    stay = text_groups(docs, key, text, limit).select(
        F.col("text_sha256").alias(sha), text_key(F.col("keep_id")).alias(who), F.col("chars").alias(most))
    marked = docs.withColumns({
        sha: F.sha2(normalised(named(text)).cast("binary"), 256), who: text_key(named(key)),
        size: F.coalesce(F.char_length(named(text)), F.lit(0)).cast("long")})
    # Joined by key and digest: the copies of a hot text go to different tasks. No row is longer than
    # ``most``; an equality would become a key of the join, whose partitions the last step uses too.
    met = marked.join(stay, [who, sha]).where(named(size) >= named(most))
    return met.dropDuplicates([who, sha]).select(*map(named, docs.columns))
