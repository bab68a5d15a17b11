"""Writers for stored posts and searches (captures have their own module)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_day(df: DataFrame, ts="dateTweet") -> DataFrame:
    """Add the partition column ``day``, so date filters skip whole folders."""
    return df.withColumn("day", F.to_date(ts))


def write_posts(df: DataFrame, path: str, ts="dateTweet", author: str | None = None, **options) -> None:
    """Append stored posts, one folder per day.

    Rows are gathered by day, so a day is not scattered over one small file per task.
    The rebalance hint lets Spark split a day that holds a large share of all posts
    into several tasks and join small ones.

    ``author``: a column by which the posts of a file are sorted and for which its row groups hold
    Bloom filters. ``by_author`` then reads the row groups that may hold the author only: within a
    file those whose range covers the name, over files those whose filter knows it. ``options``
    are those of the Parquet writer.
    """
    rows = by_day(df, ts).hint("rebalance", "day")
    if author is not None:
        rows = rows.sortWithinPartitions("day", author)
        options = {f"parquet.bloom.filter.enabled#{author}": "true", **options}
    rows.write.mode("append").partitionBy("day").options(**options).parquet(path)


def append_posts(stream: DataFrame, path: str, checkpoint: str, ts="dateTweet", **trigger):
    """Append a stream of stored posts; exactly once through the file sink.

    Every batch leaves files of its own; ``compact_days`` puts those of days that are over into a
    store of few files per day.
    """
    return (
        by_day(stream, ts).writeStream.format("parquet").partitionBy("day")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def posts_to_json(df: DataFrame, name="json") -> DataFrame:
    """Each row as one JSON text; nulls are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def save_search(df: DataFrame, path: str) -> None:
    """Text, date and epoch of found posts."""
    df.select("text", "date", "epoch").write.mode("overwrite").parquet(path)
