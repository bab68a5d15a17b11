import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from postpulse.operators import series as S
from postpulse.operators.filters import newer_than

START = datetime(2019, 10, 24, 12, 0)
SCHEMA = "dateTweet timestamp, tweet string, screenName string"


def at(minute, second=0):
    return START + timedelta(minutes=minute, seconds=second)


def frame(spark, posts):
    return spark.createDataFrame(posts, SCHEMA)


def expected(posts, keywords, edge):
    """Series by counting in plain Python."""
    def per_minute(subset):
        return Counter(t.replace(second=0, microsecond=0) for t, _, _ in subset if t)

    index = sorted(per_minute(posts))[1:-1]
    out = []
    for name in ["All", *keywords]:
        subset = posts if name == "All" else [p for p in posts if p[1] and name in p[1]]
        counts = per_minute(subset)
        kept = sorted(counts)[1:-1] if edge == "series" else sorted(counts)
        out += [(name, m, counts[m] if m in kept else 0) for m in index]
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def posts():
    rng = random.Random(3)
    words = ["red", "redes", "metro", "paz", "", "nunca1", "una", "dos dos"]
    found = [
        (at(rng.choice([5, rng.randint(0, 40)]), rng.randint(0, 59)),
         " ".join(rng.sample(words, 3)), rng.choice("abc"))
        for _ in range(400)
    ]
    found += [(at(3), "once", "a"), (at(4), "twice", "a"), (at(9), "twice", "b")]
    found += [(at(m), "thrice", "c") for m in (2, 8, 11)]
    return found + [(None, "red", "a"), (at(7), None, "b")]


KEYWORDS = ["red", "redes", "metro", "migaja", "once", "twice", "thrice", "dos"]


@pytest.mark.parametrize("edge", ["series", "global"])
def test_keyword_series(spark, posts, edge):
    found = S.keyword_series(frame(spark, posts), KEYWORDS, edge=edge)
    assert rows(found) == expected(posts, KEYWORDS, edge)


def test_many_keywords(spark, posts):
    many = KEYWORDS + [f"absent{i}" for i in range(200)]
    assert rows(S.keyword_series(frame(spark, posts), many)) == expected(posts, many, "series")


def test_audiences_equal_separate_series(spark, posts):
    df = frame(spark, posts)
    both = S.keyword_series(
        df, KEYWORDS, audiences={"all": F.lit(True), "b": F.col("screenName") == "b"}
    )
    alone = [p for p in posts if p[2] == "b"]
    assert rows(both.where("audience = 'all'").drop("audience")) == expected(
        posts, KEYWORDS, "series")
    assert rows(both.where("audience = 'b'").drop("audience")) == expected(
        alone, KEYWORDS, "series")


def test_names_are_distinct_and_all_is_reserved(spark, posts):
    found = S.keyword_series(frame(spark, posts), ["red", "red", "All"])
    assert rows(found) == expected(posts, ["red"], "series")


def test_unknown_edge(spark, posts):
    with pytest.raises(ValueError):
        S.keyword_series(frame(spark, posts), [], edge="none")


def test_no_posts_and_two_minutes(spark):
    assert rows(S.keyword_series(frame(spark, []), ["red"])) == []
    two = [(at(0), "red", "a"), (at(1), "red", "a")]
    assert rows(S.keyword_series(frame(spark, two), ["red"])) == []


def test_posts_per_minute_keeps_gaps_out(spark):
    df = frame(spark, [(at(m), "x", "a") for m in (0, 1, 1, 5, 9)])
    assert rows(S.posts_per_minute(df)) == [(at(1), 2), (at(5), 1)]


def test_roster_series(spark, posts):
    roster = spark.createDataFrame([("b",), ("b",), ("zz",)], "handle string")
    found = S.roster_series(frame(spark, posts), roster, KEYWORDS)
    assert rows(found) == expected([p for p in posts if p[2] == "b"], KEYWORDS, "series")


def test_series_on_index(spark):
    whole = frame(spark, [(at(m), "x", "a") for m in range(6)])
    part = frame(spark, [(at(m), "x", "a") for m in (1, 2, 2, 3)])
    assert rows(S.series_on_index(part, whole)) == [
        (at(1), 0), (at(2), 2), (at(3), 0), (at(4), 0)]


def test_roster_matrix(spark):
    df = frame(spark, [
        (at(0, 1), "red y metro", "a"), (at(0, 1), "red", "b"), (at(0, 2), "metro", "b"),
        (at(1), None, "a"),
    ])
    roster = spark.createDataFrame([("a",), ("a",)], "handle string")
    found = S.roster_matrix(df, roster, ["red", "metro"])
    assert found.columns == ["ts", "All", "red", "metro"]
    assert rows(found) == [(at(0, 1), 1, 1, 1), (at(0, 2), 0, 0, 0), (at(1), 1, 0, 0)]


def test_totals_and_doc_counts(spark, posts):
    df = frame(spark, posts)
    totals = Counter()
    for name, _, n in expected(posts, KEYWORDS, "series"):
        totals[name] += n
    assert dict(rows(S.keyword_totals(S.keyword_series(df, KEYWORDS)))) == dict(totals)
    docs = {k: sum(k in p[1] for p in posts if p[1]) for k in KEYWORDS}
    assert dict(rows(S.keyword_doc_counts(df, KEYWORDS))) == docs


def test_match_keywords_counts_overlaps(spark):
    df = frame(spark, [(at(0), "redes y metro", "a"), (at(1), None, "b")])
    found = S.match_keywords(df, ["red", "redes", "metro", "o$"])
    assert [r[0] for r in rows(found, "keyword")] == ["metro", "o$", "red", "redes"]


def test_zero_fill(spark):
    counts = spark.createDataFrame([("a", at(0), 3)], "series string, ts timestamp, n long")
    index = spark.createDataFrame([(at(0),), (at(2),)], "ts timestamp")
    assert rows(S.zero_fill(counts, index, ["a", "b"])) == [
        ("a", at(0), 3), ("a", at(2), 0), ("b", at(0), 0), ("b", at(2), 0)]


def test_minute_helpers(spark):
    df = frame(spark, [(at(m), "x", "a") for m in (3, 1, 1, 7)])
    assert rows(S.minute_span(df)) == [(3, at(7))]
    assert [tuple(r) for r in S.minute_counts_closed(df).collect()] == [(at(1), 2), (at(3), 1)]
    assert [tuple(r) for r in S.counts_by_time(df).collect()] == [
        (at(1), 2), (at(3), 1), (at(7), 1)]


def test_sum_over_authors_is_the_whole(spark, posts):
    counts = frame(spark, posts).where("dateTweet is not null").groupBy(
        "screenName", F.date_trunc("minute", "dateTweet").alias("ts")).count()
    by_author = counts.groupBy("ts").agg(F.sum("count").alias("n"))
    whole = S.posts_per_minute(frame(spark, posts))
    assert rows(whole.join(by_author, ["ts", "n"])) == rows(whole)


def test_keep_last(spark):
    series = spark.createDataFrame(
        [(s, at(m), m) for s in "ab" for m in range(150)], "series string, ts timestamp, n long")
    assert rows(S.keep_last(series, 100)) == rows(series.where("n >= 50"))


def snapshots(posts, cut):
    timed = sorted((p for p in posts if p[0]), key=lambda p: p[0])
    return [p for p in timed if p[0] < cut], timed


def test_update_with_global_edges_equals_recompute(spark, posts):
    early, every = snapshots(posts, at(20, 30))
    options = {"keywords": KEYWORDS, "edge": "global"}
    state = S.keyword_series(frame(spark, early), **options)
    snapshot = S.keyword_series(frame(spark, every), **options)
    assert rows(S.update_series(state, snapshot, keep=1000)) == rows(snapshot)
    assert rows(S.update_series(state, snapshot, keep=5)) == rows(S.keep_last(snapshot, 5))


def test_update_ignores_late_posts_and_accepts_a_first_snapshot(spark, posts):
    early, every = snapshots(posts, at(20, 30))
    state = S.keyword_series(frame(spark, early), KEYWORDS)
    late = every + [(at(10, 5), "red", "late")] * 9
    new = S.keyword_series(frame(spark, late), KEYWORDS)
    last = max(r[1] for r in rows(state))
    updated = rows(S.update_series(state, new, keep=1000))
    assert [r for r in updated if r[1] <= last] == rows(state)
    assert [r for r in updated if r[1] > last] == rows(newer_than(new, last))
    empty = state.limit(0)
    assert rows(S.update_series(empty, state, keep=1000)) == rows(state)


def test_series_change(spark, posts):
    early, every = snapshots(posts, at(20, 30))
    old = S.keyword_series(frame(spark, early), ["red"])
    new = S.keyword_series(frame(spark, every), ["red"])
    newest = max(r[1] for r in rows(new))
    assert rows(S.series_change(old, new)) == [(True, newest)]
    assert rows(S.series_change(new, new)) == [(False, newest)]
    assert rows(S.series_change(old.limit(0), new)) == [(True, newest)]
    assert rows(S.series_change(new, old.limit(0))) == [(False, newest)]


def test_many_long_keywords_are_found_in_one_pass(spark):
    rng = random.Random(5)
    keywords = ["red", "redes", "", "b.d", "año", "años", "señal", "señales", "\n\tx y", "one-two", "#tag&", "😀😀😀😀",
                *{"".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(60)}]
    keywords += [k[:-1] for k in keywords if len(k) > 4] + [k + "\x01" for k in keywords[-9:]]
    keywords = list(dict.fromkeys(keywords))
    texts = ["".join(rng.choices(["a", "b", "c", "ab", "cab", " ", "\n", "\x01", *keywords[:20]], k=rng.randint(0, 40)))
             for _ in range(300)] + [None, "", "señale", "xx señales\naños", "\n\tx y😀😀😀😀😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, tweet string")
    long = S.long_keywords(keywords)
    assert len(long) >= 24
    found = df.withColumn("_held", S.held_keywords("tweet", long)).select(
        "id", *S.hit_bits(keywords, "tweet", "_held")).collect()
    for row in found:
        bits = [row[f"_hits{i // S.BITS}"] >> i % S.BITS & 1 for i in range(len(keywords))]
        text = texts[row["id"]]
        assert bits == [int(text is not None and bool(re.search(k, text))) for k in keywords], text
    timed = df.withColumn("dateTweet", F.current_timestamp())
    plan = S.keyword_series(timed, keywords)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_counts_of_many_keywords_need_no_column_each(spark):
    keywords = [f"k{i}" for i in range(50)]
    bits = spark.range(9).select(F.col("id").alias("_hits0"))
    counted = bits.groupBy().agg(S.count_bits(keywords).alias("counts"))
    assert counted.first()["counts"][:5] == [9, 4, 4, 4, 1]
    assert "_common_expr" not in counted._jdf.queryExecution().optimizedPlan().toString()
