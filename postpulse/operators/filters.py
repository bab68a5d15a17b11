"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postpulse.functions.posts import full_text, minute, parse_post_time
from postpulse.functions.text import any_keyword
from postpulse.schemas import RAW


def by_roster(df: DataFrame, roster: DataFrame, on="screenName", handle="handle") -> DataFrame:
    """Posts whose author is listed.

    A left-semi join without a hint: Spark broadcasts the roster when its measured
    size allows, else it shuffles and splits hot authors (adaptive skew join).
    """
    listed = roster.select(F.col(handle).alias("_handle"))
    return df.join(listed, df[on] == listed["_handle"], "left_semi")


def by_language(df: DataFrame, langs: Sequence[str] = ("es",), col="lang") -> DataFrame:
    return df.where(F.col(col).isin(list(langs)))


def by_author(df: DataFrame, handle: str, col="screenName") -> DataFrame:
    return df.where(F.col(col) == handle)


def by_any_keyword(df: DataFrame, keywords: Sequence[str], first=None, text="tweet") -> DataFrame:
    return df.where(any_keyword(text, keywords, first))


def in_box(
    lon: Column | str, lat: Column | str, west: float, south: float, east: float, north: float
) -> Column:
    """Position inside a bounding box, edges included; false without a position."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def ingest_filter(
    df: DataFrame,
    box: Sequence[float],
    langs: Sequence[str],
    track: Sequence[str],
    text: Column | str = "text",
    lon: Column | str = "lon",
    lat: Column | str = "lat",
    lang: str = "lang",
) -> DataFrame:
    """Live filter: (inside the box or a tracked word) and an accepted language."""
    return df.where(is_live(box, langs, track, text, lon, lat, lang))


def is_live(
    box: Sequence[float],
    langs: Sequence[str],
    track: Sequence[str],
    text: Column | str = "text",
    lon: Column | str = "lon",
    lat: Column | str = "lat",
    lang: str = "lang",
) -> Column:
    """``ingest_filter`` as a condition."""
    tracked = F.coalesce(any_keyword(text, track), F.lit(False))
    return (in_box(lon, lat, *box) | tracked) & F.col(lang).isin(list(langs))


def between_dates(df: DataFrame, since=None, until=None, ts="dateTweet") -> DataFrame:
    """``since <= ts < until``; either end may be left open."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col(ts) < F.lit(until).cast("timestamp"))
    return df


def title_contains(df: DataFrame, keyword: str, col="title") -> DataFrame:
    return df.where(F.col(col).contains(F.lit(keyword)))


def drop_blank_location(df: DataFrame, col="location") -> DataFrame:
    return df.where(F.nullif(F.col(col), F.lit("")).isNotNull())


def newer_than(df: DataFrame, last, ts="ts") -> DataFrame:
    """Rows later than ``last`` (a time or a column); a null ``last`` accepts all."""
    bound = last if isinstance(last, Column) else F.lit(last).cast("timestamp")
    return df.where(bound.isNull() | (F.col(ts) > bound))


def drop_last_minute(df: DataFrame, ts="dateTweet") -> DataFrame:
    """Drop the newest minute, which may still be filling up."""
    newest = df.agg(minute(F.max(ts))).scalar()
    return df.where(F.col(ts) < newest)


def positive_only(df: DataFrame, n="n") -> DataFrame:
    return df.where(F.col(n) > 0)


# Keys a raw post's author must carry for it to be stored. A key holding null
# is present.
REQUIRED_USER_KEYS = (
    "screen_name", "name", "url", "description", "location", "verified", "geo_enabled",
)

def with_post(df: DataFrame, col: str = "value") -> DataFrame:
    """Add ``_post``, the JSON text parsed with the raw schema, and ``_keys``, its author's keys.

    Each level is parsed once: the post with its author left as JSON text, then that short text.
    Parsing turns absent keys into nulls, so key names are taken from the author's text.
    """
    schema = StructType.fromDDL(RAW)
    outer_schema = StructType([
        StructField(f.name, StringType() if f.name == "user" else f.dataType)
        for f in schema.fields
    ])
    outer = df.withColumn("_outer", F.from_json(col, outer_schema))
    author = F.from_json("_outer.user", schema["user"].dataType)
    whole = F.struct(*[
        (author if f.name == "user" else F.col(f"_outer.{f.name}")).alias(f.name)
        for f in schema.fields
    ])
    post = F.when(F.col("_outer").isNotNull(), whole)
    return outer.withColumns({
        "_post": post, "_keys": F.json_object_keys("_outer.user"),
    }).drop("_outer")


def with_missing(df: DataFrame) -> DataFrame:
    """Add ``missing``: the parts without which a parsed post cannot be stored."""
    none = F.array().cast("array<string>")
    required = F.array(*map(F.lit, REQUIRED_USER_KEYS))
    absent = F.array_except(required, F.coalesce("_keys", none))
    missing = F.concat(
        F.transform(absent, lambda k: F.concat(F.lit("user."), k)),
        F.when(full_text("_post").isNull(), F.array(F.lit("text"))).otherwise(none),
        F.when(parse_post_time("_post.created_at").isNull(), F.array(F.lit("created_at")))
        .otherwise(none),
    )
    return df.withColumn("missing", missing).drop("_keys")


def split_rejects(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Raw JSON lines -> (good, rejects).

    Rejected: not JSON, no usable text or time, or a required author key absent.
    ``rejects`` carries the JSON and the missing parts.
    """
    judged = with_missing(with_post(df, col)).drop("_post")
    good = judged.where(F.size("missing") == 0).drop("missing")
    return good, judged.where(F.size("missing") > 0)
