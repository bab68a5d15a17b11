"""Projections of raw posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.functions.posts import (
    full_text,
    minute_epoch,
    news_epoch,
    parse_post_time,
    shift_hours,
    to_local_time,
)
from postpulse.functions.text import hashtags
from postpulse.schemas import CAPTURE, RAW, STORED


def parse_posts_json(df: DataFrame, col: str, schema=RAW) -> DataFrame:
    """JSON text column -> columns of ``schema``; the other columns are kept."""
    others = [c for c in df.columns if c != col]
    parsed = df.select(*others, F.from_json(F.col(col), schema).alias("_post"))
    return parsed.select(*others, "_post.*")


def flatten_post(df: DataFrame, tz: str | None = None, with_id: bool = False) -> DataFrame:
    """Raw post -> the stored fields, times in UTC unless ``tz`` is given.

    ``with_id`` adds ``ingest_id``: the post's own id, which grows with time, so
    "the newest N" of a store can be read by it.
    """
    text = full_text()
    fields = {
        "dateTweet": to_local_time(parse_post_time("created_at"), tz),
        "tweet": text,
        "screenName": F.col("user.screen_name"),
        "name": F.col("user.name"),
        "user_url": F.col("user.url"),
        "description": F.col("user.description"),
        "location": F.col("user.location"),
        "verified": F.col("user.verified"),
        "geoEnabled": F.col("user.geo_enabled"),
        "hash_tags": hashtags(text),
    }
    columns = [fields[f.name].alias(f.name) for f in STORED.fields]
    if with_id:
        columns.append(F.col("id").alias("ingest_id"))
    return df.select(*columns)


def capture_row(df: DataFrame, tz: str | None = None) -> DataFrame:
    """Raw post -> capture columns. Only the post's own time is moved to ``tz``."""
    text = full_text()
    special = {
        "text": text,
        "created_at": to_local_time(parse_post_time("created_at"), tz),
        "user_created_at": parse_post_time("user.created_at"),
        "hash_tags": F.to_json(hashtags(text)),
    }

    def source(name: str) -> Column:
        if name in special:
            return special[name]
        return F.col(f"user.{name[5:]}" if name.startswith("user_") else name)

    return df.select(*[source(f.name).alias(f.name) for f in CAPTURE.fields])


def user_locations(df: DataFrame, user="screenName", location="location") -> DataFrame:
    """(user, location) per post."""
    return df.select(F.col(user).alias("user"), F.col(location).alias("location"))


def post_entities(df: DataFrame, hours: int = -3) -> DataFrame:
    """Time (moved by ``hours``), user, mentioned users, tags and location of raw posts."""
    return df.select(
        shift_hours(parse_post_time("created_at"), hours).alias("time"),
        F.col("user.screen_name").alias("user"),
        F.col("entities.user_mentions.screen_name").alias("user_mentions"),
        F.col("entities.hashtags.text").alias("hashtags"),
        F.col("user.location").alias("location"),
    )


def post_times(df: DataFrame, ts="dateTweet", text="tweet") -> DataFrame:
    """Text, time and minute as epoch seconds of each post."""
    return df.select(
        F.col(text).alias("text"), F.col(ts).alias("date"), minute_epoch(ts).alias("epoch")
    )


def news_time(df: DataFrame) -> DataFrame:
    """Title and epoch seconds of each article."""
    return df.select(
        "title", news_epoch("publication_date", "publication_hour").alias("epoch")
    )
