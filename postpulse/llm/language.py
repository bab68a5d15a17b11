"""Language ID by prediction by partial matching over byte contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.llm.common import fresh, in_tasks, joined_bytes, named, slices

ORDER = 3  # bytes of the longest context
DOCS = 400  # per language that the trees are grown from, whole texts
LANGUAGES = 32  # that are learned, those with the most documents
SALT = 16  # portions in which a language's keys are first ranked
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def training_rows(docs: DataFrame, learn: Column, per_language: int, key: str, text: str,
                  lang: str, languages: int = LANGUAGES) -> DataFrame:
    """Whole texts of at most ``per_language`` keys of each language, those of the smallest hashes.

    A key counts once however often it is repeated, with one of its texts, the one of the smallest
    digest. Of more than ``languages`` different values of ``lang`` (a documented bound; dirty columns
    can hold any number) those with the most keys are learned, ties by name. Only ids and languages
    are ranked, in portions first, so that what one task ranks doesn't grow with the corpus; texts
    are fetched for the rows chosen.
    """
    known = docs.where(learn & named(lang).isNotNull() & named(text).isNotNull())
    ids = known.select(named(key).cast("string").alias("k"), named(lang).alias("l")).distinct()
    common = ids.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(languages)
    at = F.xxhash64("k")
    first = ids.join(F.broadcast(common.select("l")), "l").withColumn("s", F.pmod(at, F.lit(SALT)))
    first = first.withColumn("n", F.row_number().over(
        Window.partitionBy("l", "s").orderBy(at, "k"))).where(F.col("n") <= per_language)
    chosen = first.withColumn("n", F.row_number().over(
        Window.partitionBy("l").orderBy(at, "k"))).where(F.col("n") <= per_language).select("k", "l")
    rows = known.select(named(key).cast("string").alias("k"), named(lang).alias("l"),
                        named(text).cast("binary").alias("text"))
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("l") == F.col("_l"))
    wanted = F.broadcast(chosen.select(F.col("k").alias("_k"), F.col("l").alias("_l")))
    met = rows.join(wanted, same)  # per_language times languages keys at most
    one = met.groupBy("k", "l").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    return one


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of ORDER + 1 bytes in each language's texts, a zero byte run before each."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            texts = [v.as_py() for v, at in zip(batch.column(1), langs, strict=True) if at == lang]
            data = np.frombuffer(b"".join(bytes(ORDER) + t for t in texts if t), np.uint8)
            for i in range(0, max(len(data) - ORDER, 0), _PIECE):
                part = data[i: i + _PIECE + ORDER].astype(np.uint64)
                grams = np.zeros(len(part) - ORDER, np.uint64)
                for k in range(ORDER + 1):
                    grams = grams << np.uint64(8) | part[k: k + len(grams)]
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()),
                     pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])


@dataclass
class ContextTrees:
    """Frozen code lengths for every language, context and next byte.

    ``classes`` maps bytes to symbols (0: bytes never seen). ``step`` maps (context, symbol) to
    the longest known context after it. ``bits[context * symbols + symbol]`` has a code length for
    each language.
    """

    langs: list[str]
    classes: np.ndarray
    symbols: int
    second: np.ndarray
    third: np.ndarray
    bits: np.ndarray


def grow(counts: list[tuple[str, int, int]]) -> ContextTrees | None:
    """Context trees from (language, run of ORDER + 1 bytes, count).

    A context's symbols get n / (total + distinct), its escape distinct / (total + distinct) times
    what the context one byte shorter gives; below the empty context all 256 bytes are equal.
    """
    langs = sorted({c[0] for c in counts})
    if not langs:
        return None
    where = {name: i for i, name in enumerate(langs)}
    lang = np.array([where[c[0]] for c in counts])
    gram = np.array([c[1] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)
    seen = np.array([gram >> 8 * k & 255 for k in range(ORDER + 1)])
    used = np.unique(seen)
    classes = np.zeros(256, np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    symbols = len(used) + 1
    coded = classes[seen]  # [0]: the byte itself, [k]: the byte k before it
    pairs = np.unique(coded[2] * symbols + coded[1])
    triples = np.unique((coded[3] * symbols + coded[2]) * symbols + coded[1])
    # Context numbers: 0 the empty one, then single bytes, pairs and triples.
    first_pair, first_triple = 1 + symbols, 1 + symbols + len(pairs)
    second = np.arange(symbols, dtype=np.int64)[None, :].repeat(symbols, 0) + 1
    second[pairs // symbols, pairs % symbols] = first_pair + np.arange(len(pairs))
    contexts = first_triple + len(triples)
    third = second[None, :, :].repeat(symbols, 0)  # by the three bytes before
    third[triples // symbols ** 2, triples // symbols % symbols, triples % symbols] = \
        first_triple + np.arange(len(triples))
    shorter = np.zeros(contexts, np.int64)  # the context without its first byte
    shorter[first_pair:first_triple] = pairs % symbols + 1
    shorter[first_triple:] = second[triples // symbols % symbols, triples % symbols]
    bits = np.zeros((contexts, symbols, len(langs)), np.float32)
    ranks = [np.zeros(1, np.int64), np.arange(1, first_pair), np.arange(first_pair, first_triple),
             np.arange(first_triple, contexts)]
    of = [np.zeros(len(gram), np.int64), coded[1] + 1, second[coded[2], coded[1]],
          third[coded[3], coded[2], coded[1]]]
    for k in range(len(langs)):
        mine = lang == k
        for nodes, at in zip(ranks, of, strict=True):
            place = (at[mine] - nodes[0]) * symbols + coded[0][mine]
            table = np.bincount(place, n[mine], len(nodes) * symbols).reshape(-1, symbols)
            total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            below = np.full((1, symbols), 1 / 256) if nodes[0] == 0 else \
                2.0 ** -bits[shorter[nodes], :, k].astype(np.float64)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            chance = np.where(table > 0, table / np.maximum(total + distinct, 1), escape * below)
            bits[nodes, :, k] = -np.log2(chance)
    return ContextTrees(langs, classes.astype(np.uint8 if symbols <= 256 else np.uint16), symbols,
                        second, third.reshape(-1).astype(np.int32),
                        bits.reshape(-1, len(langs)))


def code_lengths(model: ContextTrees, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of every text of a byte array under every language: (texts, languages)."""
    sums = np.zeros((len(ends), len(model.langs)))
    starts = np.concatenate([[0], ends[:-1]])
    s, low = model.symbols, int(model.classes[0])
    for i in range(0, len(data), _PIECE):
        stop = min(i + _PIECE, len(data))
        back = data[max(i - ORDER, 0): stop]
        sym = np.full(stop - i + ORDER, low, np.int64)
        sym[len(sym) - len(back):] = model.classes[back]
        begun = starts[(starts >= i - ORDER) & (starts < stop)] - i  # texts that begin here
        now = sym[ORDER:]
        before = []
        for k in range(1, ORDER + 1):
            past = sym[ORDER - k: len(sym) - k].copy()
            for j in range(k):  # bytes of the text before are no context
                at = begun + j
                past[at[(at >= 0) & (at < len(past))]] = low
            before.append(past)
        context = model.third[(before[2] * s + before[1]) * s + before[0]].astype(np.int64)
        bits = model.bits[context * s + now]
        first = np.searchsorted(ends, i, "right")
        last = np.searchsorted(ends, stop, "left") + 1
        cut = np.clip(starts[first:last], i, stop) - i
        full = np.clip(ends[first:last], i, stop) - i > cut
        for k in range(bits.shape[1]):
            sums[first:last, k][full] += np.add.reduceat(bits[:, k], cut[full], dtype=np.float64)
    return sums


def _predict(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The text comes last; ``names`` are those of text, language and score."""
    trees = model.value
    for batch in slices(batches, names[0], _PIECE):
        data, ends = joined_bytes(batch.column(batch.num_columns - 1))
        texts = batch.column(batch.num_columns - 1)
        bits = code_lengths(trees, data, ends)
        chance = 2.0 ** (bits.min(axis=1, keepdims=True) - bits)
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        lang, score = [], []
        for i in range(batch.num_rows):
            known = texts[i].is_valid and _LETTER.search(texts[i].as_py().decode("utf-8", "replace"))
            lang.append(trees.langs[best[i]] if known else UNKNOWN)
            score.append(float(chance[i, best[i]]) if known else 0.0)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            [*batch.schema.names[:-1], *names[1:]])


def train(docs: DataFrame, learn: Column, per_language: int = DOCS, key: str = "doc_id",
          text: str = "text", lang: str = "lang") -> ContextTrees | None:
    """Trees of every language among the rows where ``learn`` holds and the language is known.

    Grown from at most ``per_language`` whole texts of each (a documented bound); the counts are
    made by tasks and added up by Spark. What reaches the driver is bounded by those texts.
    """
    rows = training_rows(docs, learn, per_language, key, text, lang).select("l", "text")
    # A language's texts lie together, so a run counts once for each piece and not for each task.
    counts = in_tasks(rows.repartition("l"), _grams, "lang string, gram long, n long")
    return grow([tuple(r) for r in counts.groupBy("lang", "gram").agg(F.sum("n")).collect()])


def identify(docs: DataFrame, model: ContextTrees | None, carry: list[str], text: str = "text",
             out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``carry`` of ``docs`` and, by ``out``, language and score of every row.

    Every byte of a text is coded by every language's tree; the shortest total code wins (ties:
    the first name). The score is the winner's probability if all languages are as likely before.
    ``und`` with score 0: null text, no letter, or no language learned. Repeated rows get
    the same answer; an empty table gives an empty one.
    """
    names = [fresh(docs, n) for n in ("_text", "_lang", "_score")]
    rows = docs.select(*map(named, carry), named(text).cast("binary").alias(names[0]))
    blank = [F.lit(UNKNOWN).alias(names[1]), F.lit(0.0).alias(names[2])]
    if model is None:
        told = rows.select(*map(named, carry), *blank)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = rows.select(*map(named, carry), *blank).schema
        told = in_tasks(rows, partial(_predict, model=shared, names=names), schema)
    return told.select(*map(named, carry), named(names[1]).alias(out[0]), named(names[2]).alias(out[1]))


def language_id(docs: DataFrame, folds: int = 5, fold: int = 0, per_language: int = DOCS,
                key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold.

    Output: doc_id, held_out, lang_pred, score. ``key``, ``lang`` and others are never inputs of a
    prediction. A null key hashes as the empty text.
    """
    part = remainder(named(key), folds)
    model = train(docs, part != fold, per_language, key, text, lang)
    rows = docs.select(named(key).alias("doc_id"), (part == fold).alias("held_out"),
                       named(text).alias("text"))
    return identify(rows, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, folds: int = 5, fold: int = 0, per_language: int = DOCS,
               key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told (not ``und``).

    Null texts and texts without a letter go, and all rows where no language was learned. Repeated rows
    and null keys are judged each; an empty table gives an empty one; any column names may occur.
    """
    part = remainder(named(key), folds)
    model = train(docs, part != fold, per_language, key, text, lang)
    told, score = fresh(docs, "_told"), fresh(docs, "_sure")
    rows = identify(docs, model, docs.columns, text, (told, score))
    return rows.where(named(told) != UNKNOWN).select(*map(named, docs.columns))
