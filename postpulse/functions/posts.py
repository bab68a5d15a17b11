"""Columns taken from a raw post, and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.constants import NEWS_TIME_FORMAT, POST_TIME_FORMAT
from postpulse.functions.text import strip_first


def full_text(post: str | None = None) -> Column:
    """Untruncated text of a raw post; a repost never falls back to the outer text.

    ``post`` names the struct column holding it; without one its fields are columns.
    """
    def part(path: str) -> Column:
        return F.col(f"{post}.{path}" if post else path)

    return F.when(
        part("retweeted_status").isNotNull(),
        F.coalesce(
            part("retweeted_status.extended_tweet.full_text"), part("retweeted_status.text")
        ),
    ).otherwise(F.coalesce(part("extended_tweet.full_text"), part("text")))


def parse_post_time(col: Column | str) -> Column:
    """``Thu Oct 24 14:39:39 +0000 2019`` -> timestamp; null where it does not parse."""
    return F.try_to_timestamp(F.substr(col, F.lit(5)), F.lit(POST_TIME_FORMAT))


def to_local_time(col: Column | str, tz: str | None) -> Column:
    """UTC instant -> wall clock of ``tz``; unchanged without ``tz``."""
    instant = F.col(col) if isinstance(col, str) else col
    return F.from_utc_timestamp(instant, tz) if tz else instant


def shift_hours(col: Column | str, hours: int) -> Column:
    """Move a time by whole hours."""
    instant = F.col(col) if isinstance(col, str) else col
    return instant + F.make_dt_interval(hours=F.lit(hours))


def minute(col: Column | str) -> Column:
    """Floor to the minute."""
    return F.date_trunc("minute", col)


def minute_epoch(col: Column | str) -> Column:
    """Epoch seconds of the minute a post falls in."""
    return F.unix_timestamp(minute(col))


def news_epoch(date: Column | str, hour: Column | str) -> Column:
    """Epoch seconds of an article; the date text has one leading character to drop."""
    text = F.concat_ws(" ", strip_first(date), hour)
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(NEWS_TIME_FORMAT)))
