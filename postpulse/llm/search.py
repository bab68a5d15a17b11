"""Exact top-k inner products with MaxScore over inverted lists of vector components."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.common import in_tasks, named

SHARD = 4096  # vectors in a shard, about
SCALE = 1024.0


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < float("inf"))), F.lit(False))


def _kth(scores: np.ndarray, k: int):
    """The k-th highest."""
    if scores.dtype == object:
        return sorted(scores, reverse=True)[k - 1]
    return np.partition(scores, -k)[-k]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as Python's integers where 64 bits can't hold one."""
    if not len(values) or np.abs(values).max() < 2.0 ** 51:
        return np.floor(SCALE * values).astype(np.int64)
    # Beyond 2^52 a double has no fraction.
    return np.array([int(x) * 1024 if abs(x) >= 2.0 ** 52 else math.floor(SCALE * x)
                     for x in values.tolist()] + [None], object)[:-1]


def score_order(score: int) -> str:
    """A text by which scores beyond 64 bits sort as numbers; ``1`` for all others."""
    if -2 ** 63 <= score < 2 ** 63:
        return "1"
    digits = str(abs(score))
    if score > 0:
        return f"2{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


class Shard:
    """Inverted lists of integer vectors: for each dimension its positive and its negative ones."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], exact: bool = False):
        """``exact``: with Python's integers, for sums that 64 bits don't hold."""
        self.ids = np.array(ids, np.int64)
        self.width = max([len(v) for v in vectors], default=0)
        self.most = max([int(np.abs(v).max()) for v in vectors if len(v)], default=0)
        self.kind = object if exact else np.int64
        self.rows = np.zeros((len(ids), self.width), self.kind)
        for row, v in zip(self.rows, vectors, strict=True):
            row[: len(v)] = v
        self.lists = {}
        for d in range(self.width):
            for sign in (1, -1):
                where = np.nonzero(self.rows[:, d] * sign > 0)[0]
                if len(where):
                    values = self.rows[where, d]
                    best = where[np.argsort(-values * sign, kind="stable")[:4]]
                    self.lists[d, sign] = where, values, int(np.abs(values).max()), best

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of a superset of the k best rows but ``own``, ties at the end included.

        A term is a list whose sign is the query component's; its bound is the largest product.
        Lists of the other sign only lower a score. Terms whose bounds together stay
        under the k-th best score so far are not essential: a row in none of the others can't win.
        """
        width = min(len(query), self.width)
        q = np.zeros(self.width, self.kind)
        q[:width] = query[:width]
        terms = [(abs(int(q[d])) * found[2], d, found) for d in np.nonzero(q)[0]
                 if (found := self.lists.get((d, 1 if q[d] > 0 else -1)))]
        terms.sort(key=lambda t: t[0])
        seeds = np.unique(np.concatenate(
            [np.arange(min(2 * k, len(self.ids))), *(t[2][3] for t in terms[-24:])]).astype(int))
        seeds = seeds[self.ids[seeds] != own]
        scores = self.rows[seeds] @ q
        level = _kth(scores, k) if len(scores) >= k else None
        bounds = np.cumsum(np.array([t[0] for t in terms], self.kind))
        if level is None or level <= 0:
            # Rows in no list at all may win, so every row is a candidate.
            alive, essential = np.arange(len(self.ids)), 0
            sums, others = np.zeros(len(self.ids), self.kind), terms
        else:
            essential = int(np.searchsorted(bounds, level, "left"))
            sums = np.zeros(len(self.ids), self.kind)
            met = np.zeros(len(self.ids), bool)
            for _, d, (where, values, _, _) in terms[essential:]:
                sums[where] += q[d] * values
                met[where] = True
            others = terms[:essential]
            alive = np.nonzero(met)[0]
            alive = alive[sums[alive] + (bounds[essential - 1] if essential else 0) >= level]
            rest = int(bounds[essential - 1]) if essential else 0
            # The dimensions of essential terms also lower scores where the signs differ.
            for _, d, _ in reversed(terms[essential:]):
                if len(alive) <= 4 * k:
                    break
                sums[alive] += np.minimum(q[d] * self.rows[alive, d], 0)
                alive = alive[sums[alive] + rest >= level]
            for bound, d, _ in reversed(others):
                if len(alive) <= 4 * k:
                    break
                sums[alive] += q[d] * self.rows[alive, d]
                rest -= bound
                alive = alive[sums[alive] + rest >= level]
        alive = alive[self.ids[alive] != own]
        scores = self.rows[alive] @ q
        if len(alive) > k:
            keep = scores >= _kth(scores, k)
            alive, scores = alive[keep], scores[keep]
        return self.ids[alive], scores


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, its vectors before its queries."""
    at, index, wide, ids, vectors = None, None, None, [], []
    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        flat, ends = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets)
        cuts = np.concatenate([[0], np.cumsum(ends)])
        out: list[tuple] = []
        for i, (shard, kind, key) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if shard != at:
                at, index, wide, ids, vectors = shard, None, None, [], []
            v = whole_numbers(flat[cuts[i]: cuts[i + 1]])
            if kind == 0:
                ids.append(key)
                vectors.append(v)
                continue
            if index is None:
                index = Shard(ids, vectors, any(x.dtype == object for x in vectors))
            most = int(np.abs(v).max()) if len(v) else 0
            used, q = index, v
            if index.kind is not object and most * index.most * max(index.width, 1) >= 1 << 62:
                # Sums of this query and this shard may not fit.
                wide = wide or Shard(ids, vectors, True)
                used = wide
            if used.kind is object:
                q = v.astype(object)
            found, scores = used.top(q, key, k)
            best = sorted(zip((-scores).tolist(), found.tolist(), strict=True))[:k]
            mark = zlib.crc32(repr(v.tolist()).encode())
            out += [(key, mark, b, max(min(-a, 2 ** 63 - 1), -2 ** 63), score_order(-a)) for a, b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)],
            ["query_id", "mark", "vec_id", "score", "beyond"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id",
          vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k best inner products of the query rows (key divisible by ``every``) with all others.

    Components are floor(1024 * x); scores are exact integers. Where the largest components of a query and
    of a shard could make a sum that 64 bits don't hold, that query is scored there with Python's
    integers; ranks are right in any case, and a score beyond 64 bits is given as the nearest
    long. Vectors that are null or hold a
    null or non-finite component take no part, null keys neither. Shorter vectors count as ending
    in zeros. Rows with the query's key are its own and left out; other repeated rows are
    candidates each; repeated query rows are one query.

    Output: query_id, rank from 1, vec_id, score; ties to the smaller vec_id; all candidates if
    there are fewer than ``k``. An empty table gives an empty one. Other columns aren't read.

    Vectors are dealt into shards of about ``shard``; each query goes to every shard once,
    streamed against the shard's lists, and gives it at most k rows to merge.
    """
    rows = vectors.where(named(key).isNotNull() & usable(named(vector))).select(
        named(key).cast("long").alias("id"),
        F.transform(named(vector), lambda x: x.cast("double")).alias("vector"))
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.select((F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
                        F.lit(0).alias("kind"), "id", "vector")
    queries = rows.where(F.col("id") % every == 0).distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(1).alias("kind"), "id", "vector")
    ready = dealt.union(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    met = in_tasks(ready, partial(_search, k=k), "query_id long, mark long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id", "mark").orderBy(
        F.desc("beyond"), F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
