import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark import StorageLevel
from pyspark.sql import functions as F

from postpulse.operators.project import capture_row, flatten_post, parse_posts_json
from postpulse.operators.series import count_matches, keyword_series, unpivot_counts
from postpulse.plans.report import dashboard, keyword_weights, word_weights
from postpulse.sources.captures import read_captures, stream_capture
from postpulse.operators.newest import newest
from postpulse.sources.posts import read_posts, stream_lines, stream_posts
from postpulse.sources.sinks import append_posts
from postpulse.streaming.ingest import compact_days, ingest_stream, refresh_trigger
from postpulse.streaming.minutes import minute_stream
from postpulse.streaming import late, moving
from postpulse.streaming.refresh import refresh_once, refresh_stream, refreshed
from test_filters import raw, without_user

START = datetime(2019, 10, 24, 12, 0)
KEYWORDS = ["red", "metro", "migaja"]


def feed(folder, name, *posts):
    folder.mkdir(exist_ok=True)
    text = "\n".join(p if isinstance(p, str) else json.dumps(p) for p in posts)
    (folder / name).write_text(text + "\n")


def make_posts(count, seed=1, minutes=60):
    rng = random.Random(seed)
    return [
        (START + timedelta(seconds=rng.randint(0, minutes * 60 - 1)),
         " ".join(rng.choices(["red", "metro", "paz", "año"], k=3)), i)
        for i in range(count)
    ]


def test_trigger_defaults_to_the_refresh_period():
    assert refresh_trigger() == {"processingTime": "30 seconds"}
    assert refresh_trigger(None) == {"availableNow": True}


def ingest(spark, base, **options):
    run = ingest_stream(
        stream_lines(spark, str(base / "feed"), files_per_batch=1), str(base / "posts"),
        str(base / "captures"), str(base / "rejects"), str(base / "checkpoint"),
        period=None, **options)
    run.awaitTermination()


def test_ingest_survives_bad_posts_and_restarts(spark, tmp_path):
    feed(tmp_path / "feed", "1.json", raw(text="uno #a"), "{broken", without_user("url"))
    feed(tmp_path / "feed", "2.json", raw(text="dos"), raw(created_at="never"))
    ingest(spark, tmp_path)
    feed(tmp_path / "feed", "3.json", raw(text="tres"))
    ingest(spark, tmp_path)  # same checkpoint: only the new file is taken
    posts = spark.read.parquet(str(tmp_path / "posts"))
    assert rows(posts, "tweet") == [("dos",), ("tres",), ("uno #a",)]
    assert posts.where("day = date'2019-10-24'").count() == 3
    rejects = spark.read.json(str(tmp_path / "rejects"))
    assert rejects.count() == 3
    captures = read_captures(spark, str(tmp_path / "captures"))
    assert rows(captures, "text", "hash_tags") == [
        ("dos", "[]"), ("tres", "[]"), ("uno #a", '["a"]')]


def test_feed_to_dashboard(spark, tmp_path):
    """What a user does: ingest, read the newest posts, show the dashboard."""
    posts = [
        raw(id=i, text=f"una red {i}", created_at=f"Thu Oct 24 14:{i:02d}:39 +0000 2019",
            user={**raw()["user"], "screen_name": "n" if i % 2 else "other"})
        for i in range(30)
    ]
    feed(tmp_path / "feed", "1.json", *posts)
    ingest(spark, tmp_path)
    newest_posts = read_posts(
        spark, str(tmp_path / "posts"), fields=["dateTweet", "tweet", "screenName"], limit=20)
    roster = spark.createDataFrame([("n",)], "handle string")
    board = dashboard(newest_posts, ["red", "metro"], {"press": roster}, ["una"])
    points = board.where("part = 'series' and name = 'All'")
    assert points.where("audience = 'everyone'").count() == 18
    assert points.where("audience = 'press'").count() == 8
    # Every press post says "red", so its own ends are the outer minutes, cut once.
    assert rows(board.where("part = 'weight'"), "audience", "name", "n") == [
        ("everyone", "red", 20), ("press", "red", 8)]


def test_repeated_batch_leaves_no_duplicates(spark, tmp_path):
    feed(tmp_path / "feed", "1.json", raw(text="uno"))
    ingest(spark, tmp_path)
    commits = tmp_path / "checkpoint" / "commits"
    for file in [*commits.glob("0"), *commits.glob(".0.crc")]:
        file.rename(tmp_path / f"lost-{file.name}")  # as if the job died before committing
    ingest(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "posts")).count() == 1
    other = tmp_path / "other"
    feed(tmp_path / "feed2", "1.json", raw(text="dos"))
    run = ingest_stream(
        stream_lines(spark, str(tmp_path / "feed2")), str(tmp_path / "posts"),
        str(other / "captures"), str(other / "rejects"), str(other / "checkpoint"), period=None)
    run.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "posts")), "tweet") == [("dos",), ("uno",)]


def test_ingest_with_live_filter(spark, tmp_path):
    point = {"type": "Point", "coordinates": [-70.6, -33.4]}
    feed(tmp_path / "feed", "1.json",
         raw(text="red"), raw(text="x", coordinates=point), raw(text="x"),
         raw(text="red", lang="en"), "{broken", raw(text="red", lang=None, created_at="never"))
    live = ((-76, -56, -66, -17), ["es"], ["red"])
    ingest(spark, tmp_path, live=live)
    assert rows(spark.read.parquet(str(tmp_path / "posts")), "tweet") == [("red",), ("x",)]
    assert spark.read.json(str(tmp_path / "rejects")).count() == 2  # whatever the filter
    stream = stream_posts(spark, str(tmp_path / "feed"), *live)
    run = append_posts(flatten_post(stream), str(tmp_path / "p2"), str(tmp_path / "c2"))
    run.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "p2")), "tweet") == [("red",), ("x",)]
    run = stream_capture(capture_row(stream), str(tmp_path / "csv"), str(tmp_path / "c3"))
    run.awaitTermination()
    assert rows(read_captures(spark, str(tmp_path / "csv")), "text") == [
        ("red",), ("x",)]


def test_a_batch_is_held_on_disk_and_without_what_is_not_written(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    held, whole = [], frame.persist

    def persist(self, level=StorageLevel.MEMORY_AND_DISK_DESER):
        held.append((level, self.toJSON().collect()))
        return whole(self, level)

    monkeypatch.setattr(frame, "persist", persist)
    feed(tmp_path / "feed", "a", raw(text="x migaja"), raw(text="left out"), "{broken")
    ingest(spark, tmp_path, live=((0.0, 0.0, 1.0, 1.0), ["es"], ["migaja"]))
    (level, lines), = held
    assert level.useDisk and not level.useMemory
    text = "".join(lines)
    assert "left out" not in text and text.count("x migaja") == 1 and text.count("{broken") == 1


def test_rejects_are_packed_and_whole(spark, tmp_path):
    lines = [raw(text=f"r{i}", created_at="never") for i in range(20)]
    feed(tmp_path / "feed", "1.json", raw(text="uno"), "{broken", *lines)
    ingest(spark, tmp_path)
    files = list((tmp_path / "rejects").rglob("part-*"))
    assert files and all(p.name.endswith(".json.gz") for p in files)
    found = spark.read.schema("value string, missing array<string>").json(str(tmp_path / "rejects"))
    texts = [json.loads(r["value"])["text"] for r in found.where("value <> '{broken'").collect()]
    assert sorted(texts) == sorted(f"r{i}" for i in range(20)) and found.count() == 21


def test_days_are_compacted_and_may_be_again(spark, tmp_path):
    days = [raw(id=i, text=f"t{i}", created_at=f"Thu Oct {20 + i % 3} 14:00:{i:02d} +0000 2019") for i in range(30)]
    for k in range(3):
        feed(tmp_path / "feed", f"{k}.json", *days[k * 10: k * 10 + 10])
    ingest(spark, tmp_path)
    landing, store = str(tmp_path / "posts"), str(tmp_path / "store")
    assert sorted(p.name for p in (tmp_path / "posts").glob("day=*")) == [f"day=2019-10-{d}" for d in (20, 21, 22)]
    for _ in range(2):
        compact_days(spark, landing, store, before="2019-10-22")
    assert rows(spark.read.parquet(store), "ingest_id") == sorted([(i,) for i in range(30) if i % 3 < 2], key=str)
    compact_days(spark, landing, store, before="2019-10-23", since="2019-10-22")
    assert spark.read.parquet(store).count() == 30
    assert len(list((tmp_path / "store").glob("day=2019-10-22/*.parquet"))) == 1


SCHEMA = "dateTweet timestamp, tweet string, ingest_id long"


def test_closed_minutes_equal_batch_counts_and_late_posts_are_ignored(spark, tmp_path):
    posts = sorted(make_posts(300))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run_once():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            minute_stream(stream, KEYWORDS, "2 minutes").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", str(tmp_path / "c"))
            .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()

    for part in (posts[:150], posts[150:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run_once()
    late = [(START + timedelta(minutes=1), "red", 999)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run_once()

    newest_time = max(p[0] for p in posts)
    counts = spark.createDataFrame(posts, SCHEMA).groupBy(
        F.date_trunc("minute", "dateTweet").alias("ts")).agg(count_matches(KEYWORDS).alias("counts"))
    closed = unpivot_counts(counts, KEYWORDS, "ts").where(
        F.col("ts") + F.expr("interval 3 minutes") <= F.lit(newest_time))
    assert rows(spark.read.parquet(out), "series", "ts", "n") == rows(closed, "series", "ts", "n")


@pytest.fixture()
def stored(spark):
    posts = sorted(make_posts(400, seed=2))
    return lambda n: spark.createDataFrame(posts[:n], SCHEMA)


def held(spark, state, part, version, audience="everyone"):
    found = refreshed(spark, state, part, version)
    return rows(found.where(F.col("audience") == audience).drop("audience"))


def test_refresh_equals_recompute_with_global_edges(spark, tmp_path, stored):
    state = str(tmp_path / "state")
    options = {"keywords": KEYWORDS, "edge": "global", "keep": 1000}
    assert refresh_once(spark, stored(150), state, 0, **options)
    assert refresh_once(spark, stored(300), state, 1, **options)
    assert refresh_once(spark, stored(400), state, 2, **options)
    before = held(spark, state, "series", 2)
    assert before == rows(keyword_series(stored(400), KEYWORDS, edge="global"))
    assert held(spark, state, "weights", 2) == rows(word_weights(stored(400)))
    refresh_once(spark, stored(400), state, 2, **options)  # repeated after a failure
    assert held(spark, state, "series", 2) == before
    assert len(list((tmp_path / "state" / "series").glob("slot=*"))) == 2


def test_refresh_without_news_keeps_words(spark, tmp_path, stored):
    state = str(tmp_path / "state")
    refresh_once(spark, stored(300), state, 0, KEYWORDS)
    same_minutes = stored(300).union(stored(300).withColumn("tweet", F.lit("otra")))
    assert not refresh_once(spark, same_minutes, state, 1, KEYWORDS)
    assert held(spark, state, "weights", 1) == rows(word_weights(stored(300)))
    assert not refresh_once(spark, stored(0), str(tmp_path / "empty"), 0, KEYWORDS)


def test_refresh_keeps_the_minutes_of_an_audience_that_lags(spark, tmp_path, stored):
    who = F.when(F.col("ingest_id") % 3 == 0, F.lit("press1")).otherwise(F.lit("x"))
    posts = stored(400).withColumn("screenName", who)
    press = posts.where("screenName = 'press1'").drop("screenName")
    early = posts.where((F.col("screenName") == "x") | (F.col("dateTweet") < START + timedelta(minutes=20)))
    roster = {"press": spark.createDataFrame([("press1",)], "handle string")}
    state = str(tmp_path / "state")
    options = {"rosters": roster, "edge": "global", "keep": 1000}
    refresh_once(spark, early, state, 0, KEYWORDS, **options)
    assert refresh_once(spark, posts, state, 1, KEYWORDS, **options)
    whole = keyword_series(press, KEYWORDS, edge="global")
    assert held(spark, state, "series", 1, "press") == rows(whole)
    assert held(spark, state, "weights", 1, "press") == rows(keyword_weights(whole))


def test_refresh_stream(spark, tmp_path, stored):
    path, state = str(tmp_path / "posts"), str(tmp_path / "state")

    def run():
        lines = spark.readStream.schema(SCHEMA).parquet(path)
        refresh_stream(
            lines, lambda s: newest(s.read.schema(SCHEMA).parquet(path), 350, "ingest_id"), state,
            str(tmp_path / "c"), KEYWORDS, period=None, keep=20, words=2,
        ).awaitTermination()

    stored(300).write.parquet(path)
    run()
    stored(400).join(stored(300), "ingest_id", "left_anti").select(
        "dateTweet", "tweet", "ingest_id").write.mode("append").parquet(path)
    run()
    snapshot = newest(spark.read.parquet(path), 350, "ingest_id")
    kept = refreshed(spark, state, "series", 1)
    assert rows(kept.groupBy("series").count()) == [(s, 20) for s in sorted(["All", *KEYWORDS])]
    assert held(spark, state, "weights", 1) == rows(word_weights(snapshot, 2))


def test_parsed_batch_matches_streamed_text(spark, tmp_path):
    feed(tmp_path / "feed", "1.json", raw(text="uno"))
    batch = spark.read.text(str(tmp_path / "feed"))
    assert flatten_post(parse_posts_json(batch, "value")).first()["tweet"] == "uno"


# ---- words of a moving window ------------------------------------------------

def window_words(posts, n):
    """{word: posts} of the newest n, counted from their texts."""
    newest_ids = sorted((r.ingest_id for r in posts.select("ingest_id").collect() if r.ingest_id is not None),
                        reverse=True)[:n]
    low = newest_ids[-1] if newest_ids else 0
    return dict(rows(moving.count_window(posts.where(F.col("ingest_id") >= low))))


def test_moving_words_equal_recounting(spark, tmp_path):
    rng = random.Random(2)
    words = [a + b for a in "wxyz" for b in "abcdefgh"] + ["áé", "#tag"]
    there = [(i, " ".join(rng.choices(words, k=6))) for i in range(-30, 400)] + [(None, "none")]
    rng.shuffle(there)
    state = str(tmp_path / "state")
    for version, last in enumerate((50, 120, 121, 121, 300, 399, 380)):
        posts = spark.createDataFrame([r for r in there if r[0] is None or r[0] <= last],
                                      "ingest_id long, tweet string")
        for _ in range(1 + version % 2):  # repeated refreshes leave the same
            read = moving.move_counts(spark, posts, state, version, 100, size=16)
        got = dict(rows(moving.moved_counts(spark, state, version)))
        assert got == window_words(posts, 100)
        if version == 3:
            assert read == []  # nothing moved
        if version == 2:
            # The buckets where the window begins and ends (22 and 121), whole ones between are kept.
            assert read == [1, 7]


def test_moving_words_take_late_posts_and_read_kept_texts_no_more(spark, tmp_path):
    state = str(tmp_path / "state")
    posts = [(i, f"a{'xyz'[i % 3]} b") for i in range(0, 100, 2)]
    frame = lambda rs: spark.createDataFrame(rs, "ingest_id long, tweet string")
    assert moving.move_counts(spark, frame(posts), state, 0, 500, size=10) == list(range(10))
    # Another text in a bucket that stays isn't seen, a late post is.
    changed = [(i, "other" if i == 4 else x) for i, x in posts] + [(51, "late b")]
    assert moving.move_counts(spark, frame(changed), state, 1, 500, size=10) == [5]
    got = dict(rows(moving.moved_counts(spark, state, 1)))
    assert got == window_words(frame([*posts, (51, "late b")]), 500)
    weights = moving.moved_weights(spark, state, 1, 2, ["b"])
    assert [r.word for r in weights.collect()] == ["ax", "az"]
    # Empty store: everything leaves.
    assert moving.move_counts(spark, frame([]), state, 2, 500, size=10) == []
    assert moving.moved_counts(spark, state, 2).count() == 0


def test_moving_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "posts")
    spark.range(0, 2000).selectExpr("id AS ingest_id", "concat('a', id) AS tweet").write.parquet(path)
    found = spark.read.parquet(path).where(moving._ranges([3, 4, 9], "ingest_id", 100))
    assert sorted(r[0] for r in found.select("ingest_id").collect()) == [
        *range(300, 500), *range(900, 1000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ingest_id,300)" in plan and "LessThan(ingest_id,500)" in plan


def test_refresh_with_moving_words(spark, tmp_path):
    frame = [(i, datetime(2024, 1, 1, 0, i % 50), f"red w{'abcdefg'[i % 7]} x", "@a") for i in range(300)]
    posts = spark.createDataFrame(frame, "ingest_id long, dateTweet timestamp, tweet string, screenName string")
    plain, moved = str(tmp_path / "plain"), str(tmp_path / "moved")
    for version, last in enumerate((200, 299)):
        there = posts.where(F.col("ingest_id") <= last)
        snapshot = newest(there, 120, "ingest_id")

        def heavy(v, there=there):
            moving.move_counts(spark, there, f"{moved}/words", v, 120, size=20)
            return moving.moved_weights(spark, f"{moved}/words", v)
        refresh_once(spark, snapshot, plain, version, ["red"])
        refresh_once(spark, snapshot, moved, version, ["red"], weights=heavy)
    for part in ("series", "weights"):
        assert rows(refreshed(spark, moved, part, 1)) == rows(refreshed(spark, plain, part, 1))


# ---- late posts ----------------------------------------------------------------

def lots():
    """Batches of (id, minute, text): in order, then late ones, then far ahead, nulls, an empty one."""
    at = lambda m, s=0: START + timedelta(minutes=m, seconds=s)
    return [
        [(i, at(i % 20, i), "red metro" if i % 2 else "x") for i in range(60)],
        [(100, at(19), "red"), (101, at(25), "x"), (102, at(8), "red"), (103, None, "red")],  # 8 is late
        [],
        [(200, at(3), "metro"), (201, at(60), None), (202, at(16), "red")],
        [(300, at(49, 30), "red"), (301, at(50), "red"), (302, at(10), "x")],
    ]


def lot_frame(spark, lot):
    return spark.createDataFrame(lot, "id long, dateTweet timestamp, tweet string")


@pytest.mark.parametrize("repeat", [1, 2])
def test_closed_open_and_late_are_all(spark, tmp_path, repeat):
    paths = [str(tmp_path / n) for n in ("state", "out", "late")]
    seen, newest_time, closed_until, late_ids = {}, None, None, set()
    for version, lot in enumerate(lots()):
        for _ in range(repeat):  # a batch that is repeated leaves the same
            found = late.close_minutes(lot_frame(spark, lot), version, *paths, ["red", "metro"])
        missed = {i for i, t, _ in lot if t is not None and closed_until is not None
                  and t.replace(second=0) + timedelta(minutes=1) <= closed_until}
        late_ids |= missed
        assert found == {"posts": len(lot), "late": len(missed), "without_time": sum(t is None for _, t, _ in lot)}
        times = [t for _, t, _ in lot if t is not None] + ([newest_time] if newest_time else [])
        newest_time = max(times)
        closed_until = newest_time - timedelta(minutes=10)
    everything = [r for lot in lots() for r in lot if r[1] is not None]
    assert {r.id for r in spark.read.parquet(paths[2]).collect()} == late_ids
    assert late_ids >= {102, 200, 302}
    closed = spark.read.parquet(paths[1])
    open_now = late.open_minutes(spark, paths[0], 4, ["red", "metro"])
    assert closed.select("series", "ts").intersect(open_now.select("series", "ts")).count() == 0
    assert closed.count() == closed.select("series", "ts").distinct().count()  # each minute once
    on_time = [r for r in everything if r[0] not in late_ids]
    want = unpivot_counts(lot_frame(spark, on_time).groupBy(F.date_trunc("minute", "dateTweet").alias("ts")).agg(
        count_matches(["red", "metro"]).alias("counts")), ["red", "metro"], "ts").select("series", "ts", "n")
    assert rows(closed.select("series", "ts", "n").union(open_now)) == rows(want)
    assert closed.where(F.col("ts") + F.expr("INTERVAL 1 MINUTE") > F.lit(closed_until)).count() == 0
    assert late.late_counts(spark, paths[0], 4) == {"posts": sum(map(len, lots())), "late": len(late_ids)}


def test_close_stream_agrees_with_the_watermark(spark, tmp_path):
    """Closed minutes are those of the streaming window; what it drops without a word is in ``late``."""
    feed_path, told = str(tmp_path / "feed"), {}
    for lot in lots()[:2] + lots()[3:]:
        lot_frame(spark, lot).coalesce(1).write.mode("append").parquet(feed_path)
        stream = spark.readStream.schema("id long, dateTweet timestamp, tweet string").parquet(feed_path)
        late.close_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "late"),
                          str(tmp_path / "own"), KEYWORDS, seen=told.__setitem__).awaitTermination()
        run = minute_stream(stream, KEYWORDS).writeStream.format("parquet").option(
            "path", str(tmp_path / "window")).option("checkpointLocation", str(tmp_path / "check")).outputMode(
            "append").trigger(availableNow=True).start()
        run.awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out")).select("series", "ts", "n")
    assert rows(closed) == rows(spark.read.parquet(str(tmp_path / "window")).select("series", "ts", "n"))
    assert sum(t["late"] for t in told.values()) == spark.read.parquet(str(tmp_path / "late")).count() >= 3


def test_appended_posts_can_be_put_together(spark, tmp_path):
    """Files of many batches become few for each day that is over."""
    posts = spark.range(0, 300).selectExpr(
        "id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 3) AS dateTweet")
    for part in range(3):
        posts.where(F.col("id") % 3 == part).repartition(4).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "feed"))
        append_posts(stream, str(tmp_path / "landing"), str(tmp_path / "checkpoint")).awaitTermination()
    for _ in range(2):
        compact_days(spark, str(tmp_path / "landing"), str(tmp_path / "store"), before="2024-01-03")
    store = spark.read.parquet(str(tmp_path / "store"))
    assert rows(store, "id") == rows(posts.where("dateTweet < '2024-01-03'"), "id")
    files = lambda p: len(list((tmp_path / p).glob("day=2024-01-0[12]/*.parquet")))
    assert files("store") < files("landing")
