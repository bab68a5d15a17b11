"""Periodic refresh of series and word weights from the newest stored posts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postpulse.constants import POINTS_KEPT, REFRESH, TOP_WORDS
from postpulse.operators.series import EVERYONE, keyword_series, series_change, update_series
from postpulse.plans.report import keyword_weights, mark_listed, word_weights
from postpulse.streaming.ingest import refresh_trigger

SERIES = "audience string, series string, ts timestamp, n bigint"
WEIGHTS = "audience string, name string, n bigint"
KEPT = 2  # versions that stay: the newest and the one it was made from


def refreshed(spark: SparkSession, state: str, part: str, version: int) -> DataFrame:
    """The table ``series`` or ``weights`` of refresh ``version``; empty before the first one.

    Only the last two versions exist: each is written over the one before the last.
    """
    schema = SERIES if part == "series" else WEIGHTS
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/{part}/slot={version % KEPT}")


def refresh_once(
    spark: SparkSession,
    snapshot: DataFrame,
    state: str,
    version: int,
    keywords: Sequence[str],
    stopwords: Sequence[str] | DataFrame = (),
    rosters: Mapping[str, DataFrame] | None = None,
    keep: int = POINTS_KEPT,
    words: int = TOP_WORDS,
    edge: str = "series",
    ts="dateTweet",
    text="tweet",
    on="screenName",
    weights: Callable[[int], DataFrame] | None = None,
) -> bool:
    """Write the series and weights of refresh ``version`` for everyone and each roster.

    Reads the version before it and writes over the one before that, so repeating a refresh gives
    the same tables and no more than two stay. Each audience's series grow by the minutes newer
    than its own last one. Weights are words for everyone and keywords of the kept points for
    rosters; those of an audience whose ``All`` gained no minute are carried over. Returns
    whether any audience did.

    ``weights`` gives (word, n) of a refresh in place of counting the snapshot's words anew, for
    instance from counts that move on (``moving.move_counts``). It is asked in every refresh.
    """
    heavy = weights(version) if weights else None
    rosters = rosters or {}
    before = refreshed(spark, state, "series", version - 1)
    marked = mark_listed(snapshot, rosters, on) if rosters else snapshot
    audiences = {EVERYONE: F.lit(True), **{name: F.col(f"in_{name}") for name in rosters}}
    series = keyword_series(marked, keywords, ts, text, edge, audiences)
    update_series(before, series, keep, ("audience", "series")).write.mode("overwrite").parquet(
        f"{state}/series/slot={version % KEPT}")
    after = refreshed(spark, state, "series", version)
    # One row per audience.
    gained = series_change(before, after, ("audience",)).where("changed").collect()
    changed = {r["audience"] for r in gained}
    parts = [refreshed(spark, state, "weights", version - 1).where(
        ~F.col("audience").isin(sorted(changed)))]
    if EVERYONE in changed:
        heavy = word_weights(snapshot, words, stopwords, text) if heavy is None else heavy
        parts.append(heavy.select(
            F.lit(EVERYONE).alias("audience"), F.col("word").alias("name"), "n"))
    listed = after.where(F.col("audience").isin(sorted(changed - {EVERYONE})))
    parts.append(keyword_weights(listed).select("audience", F.col("series").alias("name"), "n"))
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(
        f"{state}/weights/slot={version % KEPT}")
    return bool(changed)


def refresh_stream(
    feed: DataFrame,
    snapshot: Callable[[SparkSession], DataFrame],
    state: str,
    checkpoint: str,
    keywords: Sequence[str],
    period: str | None = REFRESH,
    **options,
) -> StreamingQuery:
    """Refresh whenever ``feed`` brings new posts.

    ``snapshot`` gives the newest stored posts; a moving newest-N is not an
    append-only aggregate, so series and words are recomputed from it. From a store by
    day, ``read_posts(limit=...)`` reads the newest days only.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        refresh_once(spark, snapshot(spark), state, batch_id, keywords, **options)

    return (
        feed.select(F.lit(1)).writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint).trigger(**refresh_trigger(period)).start()
    )
