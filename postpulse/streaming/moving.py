"""Word counts of the newest N posts that move on without starting anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.constants import TOP_WORDS
from postpulse.functions.text import is_counted, words_of
from postpulse.operators.newest import nth_highest
from postpulse.operators.words import count_words, merge_counts, top_words

KEPT = 2  # versions that stay: the newest and the one it was made from
BUCKET = 10_000  # ids whose posts are counted together
COUNTS = "bucket bigint, word string, n bigint"
PLACES = "bucket bigint, posts bigint, mark bigint"
TOTALS = "word string, n bigint"


def _state(spark: SparkSession, state: str, part: str, version: int, schema: str) -> DataFrame:
    """A part of the state after refresh ``version``; empty before the first one."""
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/{part}/slot={version % KEPT}")


def moved_counts(spark: SparkSession, state: str, version: int) -> DataFrame:
    """(word, n): number of posts of the window that hold each word, after refresh ``version``."""
    return _state(spark, state, "totals", version, TOTALS)


def _bucket(ingest_id: str, size: int) -> Column:
    return F.expr(f"(CAST(`{ingest_id}` AS BIGINT) - pmod(`{ingest_id}`, {size})) div {size}")


def _bucket_places(posts: DataFrame, ingest_id: str, size: int) -> DataFrame:
    """(bucket, posts, mark): how many posts of a bucket are in the window, and which."""
    key = F.col(f"`{ingest_id}`")
    mark = F.sum(F.xxhash64(key) % F.lit(1 << 40))
    return posts.groupBy(_bucket(ingest_id, size).alias("bucket")).agg(
        F.count(F.lit(1)).alias("posts"), mark.alias("mark"))


def _ranges(buckets: Sequence[int], ingest_id: str, size: int) -> Column:
    """Ids of the buckets as ranges, which skip Parquet row groups."""
    key, found, start = F.col(f"`{ingest_id}`"), F.lit(False), None
    for i, b in enumerate(buckets):
        start = b if start is None else start
        if i + 1 == len(buckets) or buckets[i + 1] != b + 1:
            found = found | ((key >= F.lit(start * size)) & (key < F.lit((b + 1) * size)))
            start = None
    return found


def move_counts(
    spark: SparkSession,
    posts: DataFrame,
    state: str,
    version: int,
    n: int,
    ingest_id: str = "ingest_id",
    text: str = "tweet",
    size: int = BUCKET,
) -> list[int]:
    """Write the word counts of the newest ``n`` posts as refresh ``version`` of ``state``.

    Posts are counted by bucket, ``size`` successive ids. A refresh looks at the ids alone: where
    the window begins, and how many posts each bucket has in it. Buckets as they were before keep
    their counts; of all others (new ones, the one in which the window begins, one that got late or
    lost posts) the texts are read and counted. The totals are those before, plus the counts of
    what enters, less the counts of what leaves. So the texts of kept buckets aren't read again, and
    the work follows what moves, not the window.

    The newest are those with the highest ids; all that share the last id are in. Null ids
    don't count. Reads the version before and writes over the one before that, so a refresh that is
    repeated gives the same. Returns the buckets whose texts were read (one number for each; at
    first ``n / size`` of them, then those that changed).

    The state has a row for each word of each bucket and each word of the window.
    """
    ids = posts.select(F.col(f"`{ingest_id}`").cast("long").alias("v"))
    found = nth_highest(ids, n)
    key = F.col(f"`{ingest_id}`")
    window = posts.where(key.isNotNull()) if found is None else posts.where(key >= F.lit(found[0]))
    slot = f"slot={version % KEPT}"
    _bucket_places(window, ingest_id, size).write.mode("overwrite").parquet(f"{state}/places/{slot}")
    now = _state(spark, state, "places", version, PLACES)
    before = _state(spark, state, "places", version - 1, PLACES)
    same = now.join(before, ["bucket", "posts", "mark"], "left_semi").select("bucket")
    read = sorted(r[0] for r in now.join(same, "bucket", "left_anti").select("bucket").collect())

    held = _state(spark, state, "counts", version - 1, COUNTS)
    moving = window.where(_ranges(read, ingest_id, size)).select(
        _bucket(ingest_id, size).alias("bucket"), F.explode(words_of(text)).alias("word"))
    entering = moving.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n"))
    kept = held.join(same, "bucket", "left_semi")
    kept.unionByName(entering).write.mode("overwrite").parquet(f"{state}/counts/{slot}")

    counts = _state(spark, state, "counts", version, COUNTS)
    new = counts.join(same, "bucket", "left_anti")
    left = held.join(same, "bucket", "left_anti").select("word", (-F.col("n")).alias("n"))
    change = merge_counts(new.select("word", "n"), left)
    totals = merge_counts(moved_counts(spark, state, version - 1), change)
    totals.where(F.col("n") > 0).write.mode("overwrite").parquet(f"{state}/totals/{slot}")
    return read


def moved_weights(
    spark: SparkSession, state: str, version: int, n: int = TOP_WORDS,
    stopwords: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """The ``n`` words found in most posts of the window, as ``word_weights`` gives them."""
    counts = moved_counts(spark, state, version)
    if isinstance(stopwords, DataFrame):
        counted = counts.where(is_counted(F.col("word"))).join(
            stopwords.select("word"), "word", "left_anti")
    else:
        counted = counts.where(is_counted(F.col("word"), stopwords))
    return top_words(counted, n)


def count_window(posts: DataFrame, text: str = "tweet") -> DataFrame:
    """What ``moved_counts`` holds for these posts, counted from their texts."""
    return count_words(posts.select(F.explode(words_of(text)).alias("word")))
