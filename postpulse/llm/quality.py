"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.common import in_tasks, joined_bytes, named, slices
from postpulse.llm.words import Words

TRUSTED, PLAIN = 3000, 6000  # most trusted documents, and unlabelled ones of the first fit
PASSES = 2  # over all unlabelled documents, to bring the first fit to the risk of all
BINS, REACH = 1 << 14, 64.0  # of the scores of all unlabelled documents, from -REACH to REACH
SLOTS = 64  # rows to which the sums of all tasks are added up
THRESHOLD = 0.7
STEPS, RATE, DECAY = 150, 0.05, 1e-4
TAIL, MARGIN = 0.002, 0.15  # of the trusted below the threshold; of the way from there to the median
PRIOR = 0.5  # where no labelled row tells it
REPEATS = 3.0  # weight of the shares of words
_SLICE = 1 << 20


def _signs() -> tuple[np.ndarray, int]:
    """Bytes -> kinds: other, space, line break, a-z, A-Z, digit, beyond ASCII, each other sign."""
    kinds = np.zeros(256, np.uint8)
    kinds[32], kinds[9:14] = 1, 2
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 3, 4, 5, 6
    own = [c for c in range(33, 127) if not chr(c).isalnum()]
    kinds[own] = np.arange(7, 7 + len(own))
    return kinds, 7 + len(own)


KINDS, N_KINDS = _signs()
N_FEATURES = N_KINDS ** 2 + 6


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row per text: square roots of the shares of pairs of byte kinds, then shares of different
    words and of words like the one before, length, share of different lines, mean word length
    and a constant."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    # A line break stands before and behind every text.
    sign = np.insert(KINDS[data], np.append(starts, len(data)), 2)
    pairs = np.zeros(len(ends) * N_KINDS ** 2, np.int64)
    stops = ends + np.arange(1, len(ends) + 1)
    for i in range(0, len(sign) - 1, _SLICE):
        now = sign[i: i + _SLICE + 1].astype(np.int64)
        bounds = np.clip(np.concatenate([[0], stops]), i, i + len(now) - 1)
        owner = np.repeat(np.arange(len(ends)), np.diff(bounds))
        code = owner * N_KINDS ** 2 + now[:-1] * N_KINDS + now[1:]
        pairs += np.bincount(code, minlength=len(pairs))
    pairs = pairs.reshape(len(ends), -1)
    out = np.zeros((len(ends), N_FEATURES), np.float32)
    out[:, : N_KINDS ** 2] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    whole = data.tobytes()
    lines = [whole[a:b].split(b"\n") for a, b in zip(starts, ends, strict=True)]
    words = Words(data, ends)
    whose = np.repeat(np.arange(len(ends)), words.count)
    hashes = words.hashes()
    order = np.lexsort((hashes, whose))
    at, value = whose[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1])
    again = whose[1:][(hashes[1:] == hashes[:-1]) & (whose[1:] == whose[:-1])]
    n = np.maximum(words.count, 1) / REPEATS
    out[:, -6] = np.bincount(at[new], minlength=len(ends)) / n
    out[:, -5] = np.bincount(again, minlength=len(ends)) / n
    out[:, -4] = np.log1p(size) / 10
    out[:, -3] = [len(set(x)) / len(x) for x in lines]
    out[:, -2] = np.minimum(size / np.maximum(words.count, 1), 100) / 10
    out[:, -1] = 1
    return out


@dataclass
class Model:
    weights: np.ndarray
    shift: float


def risk_gradient(w: np.ndarray, trusted: np.ndarray, plain: np.ndarray, prior: float
                  ) -> tuple[float, np.ndarray]:
    """Non-negative unbiased risk under logistic loss, and the direction to step against.

    Risk of the negatives: that of the unlabelled as negatives less ``prior`` times that of the
    trusted as negatives. Where it falls below zero it counts as zero, and the step goes against
    what made it negative.
    """
    p, u = trusted @ w, plain @ w
    positive = prior * np.logaddexp(0, -p).mean()
    negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    up, uu = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
    to_positive = prior * (trusted.T @ (up - 1)) / len(p)
    to_negative = plain.T @ uu / len(u) - prior * (trusted.T @ up) / len(p)
    if negative < 0:
        return positive, -to_negative
    return positive + negative, to_positive + to_negative


def fit(trusted: np.ndarray, plain: np.ndarray, prior: float) -> np.ndarray:
    """Adam on the risk: weights of the features."""
    used = np.nonzero((trusted != 0).any(0) | (plain != 0).any(0))[0]
    p, u = trusted[:, used].astype(np.float64), plain[:, used].astype(np.float64)
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    for t in range(1, STEPS + 1):
        _, g = risk_gradient(w, p, u, prior)
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(trusted.shape[1])
    weights[used] = w
    return weights


def risk_step(w: np.ndarray, trusted: np.ndarray, plain: np.ndarray, prior: float) -> np.ndarray:
    """Weights after a step against the risk of all documents.

    ``plain`` has the sums over all unlabelled documents, as ``plain_sums`` gives them: number, risk as
    negatives, gradient and its curvature for each feature. The step is Newton's for each feature by
    itself, bounded by RATE, so that sums of a few passes suffice.
    """
    p = trusted.astype(np.float64)
    logit = p @ w
    up = 1 / (1 + np.exp(-logit))
    n, risk = plain[0], plain[1] / plain[0]
    grad, bend = plain[2:].reshape(2, -1) / n
    if risk - prior * np.logaddexp(0, logit).mean() < 0:
        go = prior * (p.T @ up) / len(p) - grad
    else:
        go = prior * (p.T @ (up - 1)) / len(p) + grad - prior * (p.T @ up) / len(p)
    bend = bend + prior * (p.T ** 2 @ (up * (1 - up))) / len(p) + DECAY
    return w - np.clip((go + DECAY * w) / bend, -RATE, RATE) * (bend > DECAY)


def threshold(known: np.ndarray, low_share: float) -> float:
    """The score that becomes THRESHOLD: a margin below the lowest of the trusted, but so that at
    least half of the negatives that the prior expects among the unlabelled stay below
    (``low_share``: the score up to which they reach)."""
    low = np.quantile(known, TAIL)
    return max(low - MARGIN * (np.median(known) - low), low_share)


def plain_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, risk as negatives, its gradient and curvature for each feature, of some documents."""
    u = x @ w
    share = 1 / (1 + np.exp(-u))
    return np.concatenate([[len(u), np.logaddexp(0, u).sum()], x.T @ share,
                           (x * x).T @ (share * (1 - share))])


def score_counts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many documents have a score in each of BINS parts."""
    place = ((x @ w + REACH) * (BINS / (2 * REACH))).clip(0, BINS - 1).astype(np.int64)
    return np.bincount(place, minlength=BINS).astype(np.float64)


def _summed(batches: Iterator[pa.RecordBatch], weights, sums) -> Iterator[pa.RecordBatch]:
    """The task's ``sums`` over its documents, as one row."""
    total = 0.0
    for batch in batches:
        for part in slices([batch], "text", _SLICE):
            total = total + sums(features(*joined_bytes(part.column(0))).astype(np.float64), weights.value)
    own = TaskContext.get().partitionId()
    rows = [] if isinstance(total, float) else [(own % SLOTS, own, total.tobytes())]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], ["slot", "task", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each slot, which come in the order of their tasks."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, _, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[slot] = found.get(slot, 0.0) + np.frombuffer(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())],
        ["slot", "sums"])


def over_all(texts: DataFrame, weights: np.ndarray, sums) -> np.ndarray:
    """``sums`` over all documents (column ``text``): by task, then by slot, then on the driver, which
    gets SLOTS rows. Added up in one order, so that runs agree."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    parts = in_tasks(texts, partial(_summed, weights=shared, sums=sums), "slot int, task int, sums binary")
    slots = in_tasks(parts.repartition("slot").sortWithinPartitions("slot", "task"), _added,
                     "slot int, sums binary").orderBy("slot").collect()
    return sum((np.frombuffer(r["sums"]) for r in slots), np.zeros(0) if not slots else 0.0)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        rows = features(*joined_bytes(batch.column(2))).astype("<f2")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())],
            ["k", "trusted", "row"])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        logit = features(*joined_bytes(batch.column(2))) @ model.value.weights + model.value.shift
        score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score, pa.float64())],
            ["doc_id", "held_out", "score"])


def _fold(key: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2,
          trusted: int = TRUSTED, plain: int = PLAIN, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model | None:
    """A model from trusted positives, unlabelled documents and the prior, all outside the fold.

    Trusted: label 1 and no other, at most ``trusted`` of them, by the smallest hashes of the key.
    A first fit takes ``plain`` documents without any label as unlabelled ones. Then all documents
    outside the fold are the unlabelled text, their labels not looked at: PASSES over them, whose
    sums are added up by Spark, bring the fit to the risk over all, and the threshold comes
    from the scores of all. The prior is the share of 1 among all labelled rows
    outside the fold (0.5 without any), kept within 0.02 and 0.98. None without documents of
    either class. Labels are read for nothing else. Null keys and null labels are not learned from.
    """
    learn = labels.where((_fold(named(key), folds) != fold) & named(key).isNotNull()
                         & named(label).isNotNull())
    told = learn.groupBy(named(key).alias("k")).agg(
        F.min(named(label)).alias("least"), F.max(named(label)).alias("most"))
    share = learn.agg(F.avg((named(label) == 1).cast("double"))).first()[0]
    prior = min(max(PRIOR if share is None else share, 0.02), 0.98)
    ids = docs.where((_fold(named(key), folds) != fold) & named(key).isNotNull()).select(
        named(key).alias("k")).distinct()
    any_label = labels.select(named(key).alias("k")).distinct()
    classed = ids.join(told.where((F.col("least") == 1) & (F.col("most") == 1)), "k", "left_semi") \
        .select("k", F.lit(True).alias("trusted")).union(
            ids.join(any_label, "k", "left_anti").select("k", F.lit(False)))
    # In portions first, so that what one task ranks doesn't grow with the corpus.
    at, most = F.xxhash64("k"), F.when(F.col("trusted"), trusted).otherwise(plain)
    first = classed.withColumn("s", F.pmod(at, F.lit(16)))
    first = first.withColumn("n", F.row_number().over(
        Window.partitionBy("trusted", "s").orderBy(at, "k"))).where(
        (F.col("n") <= most) & (F.col("n") <= max(trusted, plain)))
    chosen = first.withColumn("n", F.row_number().over(
        Window.partitionBy("trusted").orderBy(at, "k"))).where(
        (F.col("n") <= most) & (F.col("n") <= max(trusted, plain))).select("k", "trusted")
    # At most trusted + plain rows.
    rows = docs.select(named(key).alias("k"), named(text).cast("binary").alias("text")).join(
        F.broadcast(chosen), "k").select("k", "trusted", "text")
    kind = rows.select("k").schema[0].dataType.simpleString()
    made = in_tasks(rows, _featured, f"k {kind}, trusted boolean, row binary")
    # Of several texts of a key the one with the least features, so that runs agree.
    got = made.groupBy("k").agg(F.max("trusted").alias("trusted"), F.min("row").alias("row")).orderBy(
        "k").collect()
    by_class = [
        np.frombuffer(b"".join(r.row for r in got if r.trusted == want), "<f2")
        .reshape(-1, N_FEATURES).astype(np.float32) for want in (True, False)]
    if not all(map(len, by_class)):
        return None
    w = fit(*by_class, prior)
    # What text is like as a whole: labels play no part, so nothing is joined and no text shuffled.
    rest = docs.where(_fold(named(key), folds) != fold).select(named(text).cast("binary").alias("text"))
    for _ in range(PASSES):
        w = risk_step(w, by_class[0], over_all(rest, w, plain_sums), prior)
    counts = over_all(rest, w, score_counts)
    place = np.searchsorted(np.cumsum(counts), counts.sum() * (1 - prior) / 2)
    cut = threshold(by_class[0].astype(np.float64) @ w, (place + 0.5) * 2 * REACH / BINS - REACH)
    return Model(w, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2,
            key: str = "doc_id", text: str = "text", label: str = "quality", **bounds) -> DataFrame:
    """Score every whole text for quality.

    Output: doc_id, held_out, score, predicted (1 if the score is at least 0.7), one row per row of
    ``docs``. Null and empty texts are scored as the empty text. Without a model every score is 0.5.
    Repeated rows score alike; an empty table gives an empty one. Scores come from the text alone.
    """
    model = train(docs, labels, folds, fold, key=key, text=text, label=label, **bounds)
    rows = docs.select(named(key).alias("doc_id"), (_fold(named(key), folds) == fold)
                       .alias("held_out"), named(text).cast("binary").alias("text"))
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kind = rows.schema["doc_id"].dataType.simpleString()
        scored = in_tasks(rows, partial(_scored, model=shared),
                          f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
