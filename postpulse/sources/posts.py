"""Stored posts: scans, search, and the live feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.posts import full_text
from postpulse.functions.text import any_keyword
from postpulse.operators.filters import between_dates, by_language, is_live, with_post
from postpulse.operators.newest import newest

def scan_posts(
    df: DataFrame,
    condition: Column | None = None,
    fields: Sequence[str] | None = None,
    limit: int | None = None,
    ingest_id: str = "ingest_id",
    day: str | None = None,
) -> DataFrame:
    """Filter, prune and, with a limit, keep the newest posts by insertion id, in no order."""
    if condition is not None:
        df = df.where(condition)
    if limit is not None:
        if fields is not None:
            df = df.select(*dict.fromkeys([*fields, ingest_id, *([day] if day else [])]))
        df = newest(df, limit, ingest_id, day)
    return df if fields is None else df.select(*fields)


def read_posts(
    spark: SparkSession, path: str, partitions: int | None = None, **options
) -> DataFrame:
    """``scan_posts`` over a Parquet folder of stored posts.

    A store partitioned by ``day`` is read newest day first. ``partitions`` deals the rows out
    anew, for files of too few row groups to share the work; by default nothing is shuffled.
    """
    stored = spark.read.parquet(path)
    day = "day" if "day" in stored.columns else None
    found = scan_posts(stored, day=day, **options)
    return found if partitions is None else found.repartition(partitions)


def select_authors(df: DataFrame) -> DataFrame:
    """Only the authors; the scan reads one column."""
    return df.select("screenName")


def select_time_text(df: DataFrame) -> DataFrame:
    """Only time and text; the scan reads two columns."""
    return df.select("dateTweet", "tweet")


def search_posts(
    df: DataFrame,
    keywords: Sequence[str],
    lang: str = "es",
    since=None,
    until=None,
    limit: int | None = None,
    ts="dateTweet",
    text="tweet",
    first: int | None = None,
) -> DataFrame:
    """Posts with any of the keywords (of the ``first`` ones) in one language and date range.

    With a limit, the newest by time, in no order.
    """
    found = between_dates(by_language(df, [lang]), since, until, ts)
    found = found.where(any_keyword(text, keywords, first))
    return found if limit is None else newest(found, limit, ts)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Feed folder of JSON lines as a stream of raw text."""
    return (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
    )


def stream_posts(
    spark: SparkSession,
    path: str,
    box: Sequence[float],
    langs: Sequence[str],
    track: Sequence[str],
    files_per_batch: int = 1000,
) -> DataFrame:
    """Raw posts of the feed folder that pass the live filter."""
    parsed = with_post(stream_lines(spark, path, files_per_batch))
    return live_filter(parsed, box, langs, track).select("_post.*")


def live_filter(
    parsed: DataFrame, box: Sequence[float], langs: Sequence[str], track: Sequence[str]
) -> DataFrame:
    """Parsed feed lines (column ``_post``) that pass the live filter."""
    return parsed.where(passes_live(box, langs, track))


def passes_live(box: Sequence[float], langs: Sequence[str], track: Sequence[str]) -> Column:
    """The live filter as a condition on ``_post``."""
    point = F.col("_post.coordinates.coordinates")
    return is_live(
        box, langs, track, text=full_text("_post"), lang="_post.lang",
        lon=F.get(point, F.lit(0)), lat=F.get(point, F.lit(1)),
    )
