import json
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from postpulse.operators import filters as P
from postpulse.operators.project import (
    capture_row,
    flatten_post,
    parse_posts_json,
    post_entities,
    user_locations,
)
from postpulse.functions.posts import full_text


def raw(**changes):
    post = {
        "id": 1, "created_at": "Thu Oct 24 14:39:39 +0000 2019", "text": "corto #a", "lang": "es",
        "source": "web", "favorite_count": 1, "retweet_count": 2, "favorited": False,
        "retweeted": True, "geo": None, "place": {"name": "Chile"},
        "entities": {"hashtags": [{"text": "a"}], "user_mentions": [{"screen_name": "m"}]},
        "user": {
            "id": 5, "name": "N", "screen_name": "n", "url": None, "description": None,
            "location": "", "verified": True, "geo_enabled": False, "statuses_count": 3,
            "favourites_count": 4, "friends_count": 6, "listed_count": 7,
            "created_at": "Mon Feb 12 12:01:32 +0000 2007",
        },
    }
    post.update(changes)
    return post


def without_user(key):
    post = raw()
    del post["user"][key]
    return post


def lines(spark, *posts):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in posts]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


def test_full_text_rules(spark):
    long = {"full_text": "largo"}
    df = parse_posts_json(lines(
        spark,
        raw(),
        raw(extended_tweet=long),
        raw(retweeted_status={"text": "otro", "extended_tweet": long}, text="RT"),
        raw(retweeted_status={"text": "otro"}, extended_tweet=long),
        raw(retweeted_status={}, extended_tweet=long),
    ), "value")
    assert rows(df, "i", full_text()) == [
        (0, "corto #a"), (1, "largo"), (2, "largo"), (3, "otro"), (4, None)]


def test_flatten_and_local_time(spark):
    df = parse_posts_json(lines(spark, raw()), "value")
    assert flatten_post(df).first().asDict() == {
        "dateTweet": datetime(2019, 10, 24, 14, 39, 39), "tweet": "corto #a", "screenName": "n",
        "name": "N", "user_url": None, "description": None, "location": "", "verified": True,
        "geoEnabled": False, "hash_tags": ["a"],
    }
    local = flatten_post(df, "America/Santiago").first()
    assert local["dateTweet"] == datetime(2019, 10, 24, 11, 39, 39)


def test_capture_row_moves_only_the_post_time(spark):
    row = capture_row(parse_posts_json(lines(spark, raw()), "value"), "America/Santiago").first()
    assert len(row) == 25
    assert row["created_at"] == datetime(2019, 10, 24, 11, 39, 39)
    assert row["user_created_at"] == datetime(2007, 2, 12, 12, 1, 32)
    assert row["place"] == '{"name":"Chile"}' and row["geo"] is None
    assert row["hash_tags"] == '["a"]'


def test_entities(spark):
    row = post_entities(parse_posts_json(lines(spark, raw()), "value")).first()
    assert tuple(row) == (datetime(2019, 10, 24, 11, 39, 39), "n", ["m"], ["a"], "")


def test_split_rejects(spark):
    feed = lines(
        spark, raw(), without_user("url"), without_user("geo_enabled"), raw(text=None),
        raw(created_at="soon"), "{not json", raw(user=None), raw(retweeted_status={}), "",
    )
    good, rejects = P.split_rejects(feed)
    assert rows(good, "i") == [(0,)]
    missing = dict(rows(rejects.select("i", F.array_join("missing", ","))))
    assert set(missing) == set(range(1, 9))
    assert missing[1] == "user.url" and missing[2] == "user.geo_enabled"
    assert missing[3] == "text" and missing[4] == "created_at" and missing[7] == "text"
    assert rejects.columns == ["i", "value", "missing"]


def test_box_edges_and_null(spark):
    df = spark.createDataFrame(
        [(1, -70.0, -33.0), (2, -76.0, -17.0), (3, -80.0, -33.0), (4, None, -33.0)],
        "i int, lon double, lat double")
    assert rows(df.where(P.in_box("lon", "lat", -76, -56, -66, -17)), "i") == [(1,), (2,)]
    assert rows(df.where(~P.in_box("lon", "lat", -76, -56, -66, -17)), "i") == [(3,), (4,)]


def test_ingest_filter_is_box_or_words_and_language(spark):
    df = spark.createDataFrame([
        (1, -70.0, -33.0, "x", "es"), (2, None, None, "una red", "es"),
        (3, None, None, "x", "es"), (4, -70.0, -33.0, "red", "en"), (5, -70.0, -33.0, None, "es"),
    ], "i int, lon double, lat double, text string, lang string")
    found = P.ingest_filter(df, (-76, -56, -66, -17), ["es"], ["red"])
    assert rows(found, "i") == [(1,), (2,), (5,)]


def test_dates_are_half_open_and_optional(spark):
    days = [datetime(2019, 10, d) for d in (19, 20, 22, 23)]
    df = spark.createDataFrame([(d,) for d in days], "dateTweet timestamp")
    assert rows(P.between_dates(df, "2019-10-20", "2019-10-23")) == [(days[1],), (days[2],)]
    assert P.between_dates(df, since="2019-10-22").count() == 2
    assert P.between_dates(df, until="2019-10-20").count() == 1
    assert P.between_dates(df).count() == 4


def test_newer_than_accepts_all_on_null(spark):
    df = spark.createDataFrame([(datetime(2020, 1, d),) for d in (1, 2)], "ts timestamp")
    assert P.newer_than(df, None).count() == 2
    assert P.newer_than(df, datetime(2020, 1, 1)).count() == 1


def test_small_filters(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, "es"), ("b", "", 0, "en"), ("c", None, 2, None)],
        "screenName string, location string, n int, lang string")
    assert rows(P.drop_blank_location(df), "screenName") == [("a",)]
    assert rows(P.by_author(df, "b"), "screenName") == [("b",)]
    assert rows(P.by_language(df), "screenName") == [("a",)]
    assert rows(P.positive_only(df), "screenName") == [("a",), ("c",)]
    assert user_locations(df).columns == ["user", "location"]
    roster = spark.createDataFrame([("a",), ("a",), (None,)], "handle string")
    assert rows(P.by_roster(df, roster), "screenName") == [("a",)]


def test_title_is_literal_and_last_minute_dropped(spark):
    df = spark.createDataFrame([("un militar.",), ("militarx",), ("Militar",)], "title string")
    assert rows(P.title_contains(df, "militar.")) == [("un militar.",)]
    times = [datetime(2020, 1, 1, 0, m, s) for m, s in ((0, 5), (1, 0), (1, 59))]
    posts = spark.createDataFrame([(t,) for t in times], "dateTweet timestamp")
    assert rows(P.drop_last_minute(posts)) == [(times[0],)]
