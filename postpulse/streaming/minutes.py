"""Minute series of an unbounded stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.operators.series import count_matches, unpivot_counts


def minute_stream(
    posts: DataFrame, keywords: Sequence[str], delay: str = "10 minutes",
    ts="dateTweet", text="tweet",
) -> DataFrame:
    """(series, ts, n) of closed minutes, for output mode ``append``.

    A minute is emitted once the watermark passes it; later posts for it are
    ignored. State is one row per open minute, whatever the number of posts.
    """
    counted = (
        posts.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 minute").alias("_minute"))
        .agg(count_matches(keywords, text).alias("counts"))
        .withColumn("ts", F.col("_minute.start"))
    )
    return unpivot_counts(counted, keywords, "ts").select("series", "ts", "n")
