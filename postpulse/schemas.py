"""Explicit schemas of every input and output; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TEXT, _LONG, _FLAG, _TIME = StringType(), LongType(), BooleanType(), TimestampType()


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# A post as delivered by the feed, as DDL text. ``geo`` and ``place`` stay JSON text.
RAW = """
    id bigint, created_at string, text string, truncated boolean, lang string,
    source string, favorite_count bigint, retweet_count bigint,
    favorited boolean, retweeted boolean,
    extended_tweet struct<full_text: string>,
    retweeted_status struct<text: string, extended_tweet: struct<full_text: string>>,
    entities struct<
        hashtags: array<struct<text: string>>,
        user_mentions: array<struct<screen_name: string>>,
        urls: array<struct<url: string, expanded_url: string>>>,
    geo string, place string,
    coordinates struct<type: string, coordinates: array<double>>,
    user struct<
        id: bigint, name: string, screen_name: string, url: string,
        description: string, location: string, verified: boolean,
        geo_enabled: boolean, created_at: string, statuses_count: bigint,
        favourites_count: bigint, friends_count: bigint, listed_count: bigint>
"""

# The fields of a stored post.
STORED = _struct(
    dateTweet=_TIME,
    tweet=_TEXT,
    screenName=_TEXT,
    name=_TEXT,
    user_url=_TEXT,
    description=_TEXT,
    location=_TEXT,
    verified=_FLAG,
    geoEnabled=_FLAG,
    hash_tags=ArrayType(_TEXT),
)

# The columns of a capture row in the order of the file, with the dots of its
# header turned into underscores.
CAPTURE = _struct(
    text=_TEXT,
    created_at=_TIME,
    geo=_TEXT,
    lang=_TEXT,
    place=_TEXT,
    user_favourites_count=_LONG,
    user_statuses_count=_LONG,
    user_description=_TEXT,
    user_location=_TEXT,
    user_id=_LONG,
    user_created_at=_TIME,
    user_verified=_FLAG,
    user_url=_TEXT,
    user_listed_count=_LONG,
    user_friends_count=_LONG,
    user_name=_TEXT,
    user_screen_name=_TEXT,
    user_geo_enabled=_FLAG,
    id=_LONG,
    favorite_count=_LONG,
    retweeted=_FLAG,
    source=_TEXT,
    favorited=_FLAG,
    retweet_count=_LONG,
    hash_tags=_TEXT,
)

NEWS = _struct(title=_TEXT, publication_date=_TEXT, publication_hour=_TEXT)


def capture_header(name: str) -> str:
    """Column name -> name in the capture file's header (``user_id`` -> ``user.id``)."""
    return name.replace("user_", "user.", 1) if name.startswith("user_") else name


def capture_column(header: str) -> str:
    """Name in the capture file's header -> column name."""
    return header.replace(".", "_")
