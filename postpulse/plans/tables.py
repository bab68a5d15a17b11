"""Views of the test tables in the library's terms (stored posts, rosters, feed)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.sources.lists import roster_handles


PARTS = 4  # tasks that meet a stream's posts with texts, for each split of their tables


class Tables:
    """Stored posts are all ``events``, each with a whole text.

    Every tenth post has the text of a document, so very long ones come too: document i / 10 modulo
    their number. The others have a turn of a conversation: post i has conversation i modulo
    their number and goes on to its next turn each time round. Language and source are those of
    document i modulo their number. Where an id is missing the post stays, with nulls.
    """

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents")).withColumnRenamed("text", "tweet")

    @cached_property
    def events(self) -> DataFrame:
        """Every event as a post without text."""
        return as_posts(self.table("events"))

    @cached_property
    def posts(self) -> DataFrame:
        number = F.col("ingest_id") % self.table("documents").count()
        kinds = self.table("documents").select("doc_id", "lang", "source")
        placed = spread(self.events)
        # Before the texts come, so that no text is shuffled for it.
        kinded = placed.join(kinds, number == F.col("doc_id"), "left").drop("doc_id")
        return self.with_text(kinded).select(*placed.columns, "tweet", "lang", "source")

    def with_text(self, posts: DataFrame) -> DataFrame:
        """Posts (a batch or a stream) with ``tweet``.

        Documents and turns are met in one join, each under its own value of ``_long``. So no post
        comes with an empty key, and texts are shuffled once, as often as they stand in the tables.
        """
        said, docs = self.table("conversations"), self.table("documents")
        turns = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
        number, size = turns.count(), docs.count()
        long = F.col("ingest_id") % 10 == 0
        placed = posts.withColumns({
            "_long": long,
            "_id": F.when(long, F.expr(f"ingest_id div 10 % {size}")).otherwise(
                F.col("ingest_id") % number),
        })
        lengths = turns.select(F.lit(False).alias("_long"), F.col("conv_id").alias("_id"), "turns")
        placed = placed.join(lengths, ["_long", "_id"], "left").withColumn(
            "_turn", F.when(F.col("_long"), F.lit(0).cast("long")).otherwise(
                F.expr(f"ingest_id div {number}") % F.col("turns")))
        texts = said.select(F.lit(False).alias("_long"), F.col("conv_id").alias("_id"),
                            F.col("turn").alias("_turn"), F.col("text").alias("tweet")).union(
            docs.select(F.lit(True), "doc_id", F.lit(0).cast("long"), "text"))
        keys = ["_long", "_id", "_turn"]
        # In a stream the tasks of a join are a fixed number, whatever the texts; with many, more are asked for.
        if posts.isStreaming:
            splits = [self.table(name).rdd.getNumPartitions() for name in ("documents", "conversations")]
            parts = PARTS * sum(splits)
            if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                placed, texts = placed.repartition(parts, *keys), texts.repartition(parts, *keys)
        return placed.join(texts, keys, "left").drop(*keys, "turns")

    def roster(self, segment: str) -> DataFrame:
        """Customers of one market segment, listed by ``@name``."""
        rows = self.table("customer").where(F.col("c_mktsegment") == segment)
        listed = rows.select(F.concat(F.lit("@"), F.col("c_name")).alias("account"))
        return roster_handles(listed, "account").select("handle")

    @cached_property
    def feed(self) -> DataFrame:
        """Posts as JSON lines (column ``value``), in a different shape per event type."""
        return self.posts.select("ingest_id", raw_json().alias("value"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to the cores where a table has fewer splits than there are cores.

    So only tables of a few splits are shuffled; larger ones share the work as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_posts(events: DataFrame) -> DataFrame:
    """Events table (batch or stream) -> post columns without text."""
    author = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return events.select(
        F.col("event_id").alias("ingest_id"),
        F.col("ts").cast("timestamp").alias("dateTweet"),
        author.alias("screenName"),
        "user_id", "event_type", "props", "value",
    )


def feed_text() -> Column:
    return F.concat(F.lit("#"), F.col("event_type"), F.lit(" "), F.col("tweet"))


def raw_json() -> Column:
    """One feed line: reposts, long and plain posts, and posts lacking ``user.url``.

    A text is cut to 140 characters only where the whole one stands beside it.
    """
    kind = F.col("event_type")
    text, short = feed_text(), F.substring(feed_text(), 1, 140)
    stamp = F.date_format("dateTweet", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    author = {
        "id": F.col("user_id"),
        "screen_name": F.col("screenName"),
        "name": F.upper("screenName"),
        "url": F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")),
        "description": F.when(kind != "view", F.col("source")),
        "location": F.when(kind == "click", F.lit("")).otherwise(F.col("source")),
        "verified": F.col("user_id") % 2 == 0,
        "geo_enabled": F.col("user_id") % 3 == 0,
        "created_at": F.lit("Mon Feb 12 12:01:32 +0000 2007"),
        "statuses_count": F.col("user_id") * 10,
        "favourites_count": F.col("user_id") * 7,
        "friends_count": F.col("user_id") * 3,
        "listed_count": F.col("user_id"),
    }

    def struct(fields: dict) -> Column:
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def line(fields: dict, drop: str | None = None) -> Column:
        user = struct({k: c for k, c in author.items() if k != drop})
        tags = F.array(F.struct(kind.alias("text")))
        people = F.array(F.struct(F.col("screenName").alias("screen_name")))
        base = {
            "created_at": stamp, "id": F.col("ingest_id"), "user": user,
            "lang": F.col("lang"), "source": F.col("source"),
            "entities": F.struct(tags.alias("hashtags"), people.alias("user_mentions")),
            "geo": F.lit(None).cast("string"), "place": F.lit(None).cast("string"),
            "coordinates": F.struct(
                F.lit("Point").alias("type"), F.array(*position()).alias("coordinates")
            ),
            "favorite_count": F.col("user_id"), "retweet_count": F.col("user_id") * 2,
            "favorited": F.lit(False), "retweeted": F.lit(True),
        }
        return F.to_json(struct({**base, **fields}), {"ignoreNullFields": "false"})

    whole = F.struct(text.alias("full_text"))
    repost = F.struct(text.alias("text"))
    long_repost = F.struct(short.alias("text"), whole.alias("extended_tweet"))
    outer = F.lit("RT truncated")
    return (
        F.when(kind == "view", line({"text": outer, "retweeted_status": long_repost}))
        .when(kind == "click", line({"text": outer, "retweeted_status": repost}))
        .when(kind == "signup", line({"text": short, "extended_tweet": whole}))
        .when(kind == "purchase", line({"text": text}))
        .otherwise(line({"text": text}, drop="url"))
    )


def position() -> tuple[Column, Column]:
    """Longitude and latitude stand-ins."""
    lon = (F.col("user_id") % 40 - 90).cast("double")
    lat = (F.col("user_id") % 60 - 60).cast("double")
    return lon, lat


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone and lists as text, so results compare across engines."""
    def shown(field) -> Column:
        col = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "timestamp":
            col = col.cast("timestamp_ntz")
        elif kind == "array":
            col = F.array_join(col, " ")
        return col.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
