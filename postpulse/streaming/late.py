"""Closed minutes of a stream that show what came too late."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postpulse.functions.posts import minute
from postpulse.operators.series import count_matches, series_names, unpivot_counts
from postpulse.streaming.ingest import refresh_trigger

KEPT = 2  # versions that stay: the newest and the one it was made from
OPEN = "ts timestamp, counts array<bigint>"
LINE = "until timestamp, posts bigint, late bigint"


def _line(spark: SparkSession, state: str, version: int) -> tuple:
    """(until, posts, late) after batch ``version``: minutes that end by ``until`` are closed."""
    if version < 0:
        return None, 0, 0
    row = spark.read.schema(LINE).parquet(f"{state}/line/slot={version % KEPT}").first()
    return row["until"], row["posts"], row["late"]


def _open(spark: SparkSession, state: str, version: int) -> DataFrame:
    if version < 0:
        return spark.createDataFrame([], OPEN)
    return spark.read.schema(OPEN).parquet(f"{state}/open/slot={version % KEPT}")


def open_minutes(spark: SparkSession, state: str, version: int, keywords: Sequence[str]) -> DataFrame:
    """(series, ts, n) of the minutes that aren't closed after batch ``version``."""
    return unpivot_counts(_open(spark, state, version), keywords, "ts").select("series", "ts", "n")


def close_minutes(
    batch: DataFrame, version: int, state: str, out: str, late: str, keywords: Sequence[str],
    delay: str = "10 minutes", ts: str = "dateTweet", text: str = "tweet",
) -> dict[str, int]:
    """One batch: closed minutes to ``out``, late posts to ``late``, the rest to the state.

    A minute is closed when the newest time of the batches so far, less ``delay``, has passed its
    end, as ``minute_stream`` does it; posts that come for a minute closed by earlier batches
    are late. Each lot is written once, to ``batch=<version>``, which a repeated batch
    overwrites; the state of a batch is made from the one before. Posts are counted while they are
    read (an observation), without a further pass. Returns these counts: posts, late, without_time.

    State: one row of counts for each open minute. Closed minutes, open ones and late posts together
    are all posts with a time.
    """
    spark = batch.sparkSession
    until, posts, missed = _line(spark, state, version - 1)
    end = F.col("ts") + F.expr("INTERVAL 1 MINUTE")
    told = batch.withColumn("ts", minute(ts)).withColumn(
        "_late", F.lit(False) if until is None else F.coalesce(end <= F.lit(until), F.lit(False)))
    seen = Observation()
    told = told.observe(
        seen, F.count(F.lit(1)).alias("posts"), F.count_if("_late").alias("late"),
        F.count_if(F.col(ts).isNull()).alias("without_time"), F.max(ts).alias("newest"))
    rows = told.persist()
    try:
        rows.where("_late").drop("_late", "ts").write.mode("overwrite").parquet(f"{late}/batch={version}")
        found = seen.get
        counted = rows.where(~F.col("_late") & F.col("ts").isNotNull()).groupBy("ts").agg(
            count_matches(keywords, text).alias("counts"))
        width = len(series_names(keywords))
        sums = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(width)])
        both = _open(spark, state, version - 1).union(counted.select("ts", "counts"))
        both.groupBy("ts").agg(sums.alias("counts")).write.mode("overwrite").parquet(
            f"{state}/all/slot={version % KEPT}")
    finally:
        rows.unpersist()
    merged = spark.read.schema(OPEN).parquet(f"{state}/all/slot={version % KEPT}")
    newest = spark.createDataFrame([(until, found["newest"])], "until timestamp, newest timestamp").select(
        F.greatest("until", F.col("newest") - F.expr(f"INTERVAL {delay}"))).first()[0]
    closed = F.coalesce(end <= F.lit(newest), F.lit(False)) if newest is not None else F.lit(False)
    unpivot_counts(merged.where(closed), keywords, "ts").select("series", "ts", "n").write.mode(
        "overwrite").parquet(f"{out}/batch={version}")
    merged.where(~closed).write.mode("overwrite").parquet(f"{state}/open/slot={version % KEPT}")
    spark.createDataFrame([(newest, posts + found["posts"], missed + found["late"])], LINE).write.mode(
        "overwrite").parquet(f"{state}/line/slot={version % KEPT}")
    return {k: found[k] for k in ("posts", "late", "without_time")}


def close_stream(
    posts: DataFrame, state: str, out: str, late: str, checkpoint: str, keywords: Sequence[str],
    period: str | None = None, seen: Callable[[int, dict[str, int]], None] | None = None, **options,
) -> StreamingQuery:
    """``close_minutes`` for every batch of a stream of posts. ``seen`` is told each batch's counts."""
    def close(batch: DataFrame, version: int) -> None:
        found = close_minutes(batch, version, state, out, late, keywords, **options)
        if seen:
            seen(version, found)

    return (
        posts.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint)
        .trigger(**refresh_trigger(period)).start()
    )


def late_counts(spark: SparkSession, state: str, version: int) -> dict[str, int]:
    """Posts and late ones of all batches up to ``version``."""
    _, posts, late = _line(spark, state, version)
    return {"posts": posts, "late": late}
