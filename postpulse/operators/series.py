"""Minute series per keyword, and their pieces.

A family of series is one long table ``(series, ts, n)`` with a row for every
keyword in every minute of the index, plus the series ``All``. The index holds
the minutes in which something was posted, without the first and the last one;
minutes without any post are not created.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postpulse.functions.posts import minute
from postpulse.functions.text import held_keywords, keyword_sql, long_keywords, sql_text
from postpulse.operators.filters import by_roster, newer_than

ALL = "All"
EVERYONE = "everyone"

def series_names(keywords: Sequence[str]) -> list[str]:
    return [ALL, *(k for k in dict.fromkeys(keywords) if k != ALL)]


def match_keywords(
    df: DataFrame, keywords: Sequence[str], text="tweet", name="keyword", always=()
) -> DataFrame:
    """One row per post and keyword it contains, in one pass over the posts.

    A post counts for every keyword it contains. ``always`` adds names that every
    post matches.
    """
    hits = [sql_text(a) for a in always]
    hits += [
        f"CASE WHEN {keyword_sql(text, k)} THEN {sql_text(k)} END"
        for k in dict.fromkeys(keywords)
    ]
    return df.withColumn(name, F.expr(f"explode(array_compact(array({', '.join(hits)})))"))


def count_matches(keywords: Sequence[str], text="tweet", among: str = "TRUE") -> Column:
    """Array of counts, in the order of ``series_names``: posts, then posts per keyword.

    ``among`` is a SQL condition on the posts to count.
    """
    tests = [keyword_sql(text, k) for k in series_names(keywords)[1:]]
    counts = [f"count(CASE WHEN {among} THEN 1 END)"]
    counts += [f"count(CASE WHEN {among} AND {t} THEN 1 END)" for t in tests]
    return F.expr(f"array({', '.join(counts)})")


BITS = 62  # keywords in one column of hits


def hit_bits(keywords: Sequence[str], text="tweet", held: str | None = None) -> list[Column]:
    """Columns ``_hits0``, ...: bit i tells whether the text contains keyword i of its column.

    ``held`` names the column of the text's ``held_keywords``, in which the long ones are looked for.
    """
    names = series_names(keywords)[1:]
    long = set(long_keywords(names)) if held else set()

    def total(bits: list[str]) -> str:
        return " + ".join(bits) if bits else "0L"

    def column(part: list[str]) -> Column:
        bits = {k: f"CASE WHEN {keyword_sql(held if k in long else text, k)} THEN {1 << i}L ELSE 0L END"
                for i, k in enumerate(part)}
        apart = total([b for k, b in bits.items() if k not in long])
        if not long.intersection(part):
            return F.expr(apart)
        among = total([b for k, b in bits.items() if k in long])
        return F.expr(f"{apart} + CASE WHEN `{held}` != '' THEN {among} ELSE 0L END")

    parts = [names[i: i + BITS] for i in range(0, len(names), BITS)]
    return [column(part).alias(f"_hits{k}") for k, part in enumerate(parts)]


def count_bits(keywords: Sequence[str]) -> Column:
    """``count_matches`` from the columns of ``hit_bits``."""
    counts = ["count(1)"]
    # Not count_if, which makes a column of each test: too many for counts in methods small enough to be compiled.
    counts += [
        f"count(CASE WHEN _hits{i // BITS} & {1 << i % BITS}L != 0 THEN 1 END)"
        for i in range(len(series_names(keywords)) - 1)
    ]
    return F.expr(f"array({', '.join(counts)})")


def unpivot_counts(df: DataFrame, keywords: Sequence[str], *keep: str, counts="counts"):
    """Array of ``count_matches`` -> rows ``(series, n)``."""
    names = ", ".join(sql_text(name) for name in series_names(keywords))
    return df.select(*keep, F.posexplode(counts).alias("_pos", "n")).select(
        *keep, F.expr(f"element_at(array({names}), _pos + 1)").alias("series"), "n"
    )


def zero_fill(counts: DataFrame, index: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts put on the index: a row per name and indexed minute, 0 where none.

    ``counts`` has (series, ts, n), ``index`` has ts (and further columns to match).
    """
    keys = [c for c in index.columns]
    cells = index.withColumn("series", F.explode(F.array(*map(F.lit, names))))
    return (
        cells.join(counts, [*keys, "series"], "left")
        .select(*[k for k in keys if k != "ts"], "series", "ts",
                F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def trim_edges(counts: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Remove the first and the last bucket of each series.

    The window runs over buckets, never over posts, so the rows of one series are
    bounded by the length of time covered. A single series (``by=()``) is not
    gathered at all: its ends are two values looked up first.
    """
    by = list(by)
    if not by:
        ends = counts.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
        return counts.where((F.col("ts") > ends["lo"]) & (F.col("ts") < ends["hi"]))
    series = W.partitionBy(*by)
    marked = counts.select(
        "*", F.min("ts").over(series).alias("_lo"), F.max("ts").over(series).alias("_hi")
    )
    return marked.where((F.col("ts") > F.col("_lo")) & (F.col("ts") < F.col("_hi"))).select(
        counts.columns
    )


def posts_per_minute(df: DataFrame, ts="dateTweet") -> DataFrame:
    """(ts, n) per observed minute without the first and last one."""
    counts = (
        df.where(F.col(ts).isNotNull()).groupBy(minute(ts).alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return trim_edges(counts, by=())


def keyword_series(
    df: DataFrame,
    keywords: Sequence[str],
    ts="dateTweet",
    text="tweet",
    edge: str = "series",
    audiences: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(series, ts, n): posts per minute for each keyword and ``All``.

    ``edge='series'``: a keyword also loses its own first and last minute (they
    become 0), so one seen in two minutes or fewer is all zeros.
    ``edge='global'``: only the outer minutes of ``All`` are cut.

    ``audiences`` maps a name to the condition on posts that belong to it. All
    audiences are then counted in the same pass and the result gains the column
    ``audience``; each has the index of its own posts.
    """
    if edge not in ("series", "global"):
        raise ValueError("edge must be 'series' or 'global'")
    # The only pass over the texts: each post's keyword hits become bits once, whatever the
    # number of audiences it belongs to. Counts are added up per partition before the
    # shuffle, so a busy minute arrives as one row per partition and audience.
    groups = [F.when(cond, F.lit(name)) for name, cond in (audiences or {}).items()]
    member_of = F.array_compact(F.array(*groups)) if audiences else F.array(F.lit(EVERYONE))
    long = long_keywords(series_names(keywords)[1:])
    posts = df.where(F.col(ts).isNotNull()).select(
        minute(ts).alias("ts"), member_of.alias("_in"), F.col(text).alias("_text"),
        *([held_keywords(text, long).alias("_held")] if long else []),
    )
    posts = posts.select("ts", "_in", *hit_bits(keywords, "_text", "_held" if long else None))
    posts = posts.select(F.explode("_in").alias("audience"), *[c for c in posts.columns if c != "_in"])
    minutes = posts.groupBy("audience", "ts").agg(count_bits(keywords).alias("counts"))
    cells = unpivot_counts(minutes, keywords, "audience", "ts")
    # Each series has a cell in every observed minute, so its outer ends are those of ``All``.
    # The window runs over minutes, not posts, and is spread over the series.
    whole = W.partitionBy("audience", "series")
    seen = F.when(F.col("n") > 0, F.col("ts"))
    ends = cells.select(
        "*", F.min("ts").over(whole).alias("_first"), F.max("ts").over(whole).alias("_last"),
        F.min(seen).over(whole).alias("_own_first"), F.max(seen).over(whole).alias("_own_last"),
    )
    n = F.col("n")
    if edge == "series":
        n = F.when(F.col("ts").isin(F.col("_own_first"), F.col("_own_last")), F.lit(0)).otherwise(n)
    inside = (F.col("ts") > F.col("_first")) & (F.col("ts") < F.col("_last"))
    found = ends.where(inside).select("audience", "series", "ts", n.cast("long").alias("n"))
    return found if audiences else found.drop("audience")


def roster_series(
    df: DataFrame, roster: DataFrame, keywords: Sequence[str], on="screenName", **options
) -> DataFrame:
    """``keyword_series`` of the posts of listed authors, on their own minutes."""
    return keyword_series(by_roster(df, roster, on), keywords, **options)


def series_on_index(df: DataFrame, whole: DataFrame, ts="dateTweet") -> DataFrame:
    """``posts_per_minute`` of ``df`` on the inner minutes of ``whole``."""
    own = posts_per_minute(df, ts)
    return (
        posts_per_minute(whole, ts).select("ts").join(own, "ts", "left")
        .select("ts", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def roster_matrix(
    df: DataFrame, roster: DataFrame, keywords: Sequence[str],
    ts="dateTweet", text="tweet", on="screenName", handle="handle",
) -> DataFrame:
    """Wide: per exact time of any post, the listed authors' posts (``All``) and matches.

    Authors are marked rather than filtered, so one pass gives index and counts.
    """
    listed = roster.select(F.col(handle).alias("_handle")).distinct()
    marked = df.select(ts, text, on).join(listed, F.col(on) == F.col("_handle"), "left")
    counts = marked.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts")).agg(
        count_matches(keywords, text, among="_handle IS NOT NULL").alias("counts")
    )
    names = series_names(keywords)
    return counts.select("ts", *[F.col("counts")[i].alias(k) for i, k in enumerate(names)])


def keyword_totals(series: DataFrame) -> DataFrame:
    """Sum of each series."""
    keys = [c for c in series.columns if c not in ("ts", "n")]
    return series.groupBy(*keys).agg(F.sum("n").alias("n"))


def keyword_doc_counts(df: DataFrame, keywords: Sequence[str], text="tweet") -> DataFrame:
    """(series, n): posts containing each keyword, zeros kept, nothing trimmed.

    One global aggregate with a count per keyword, turned into rows at the end.
    """
    counts = unpivot_counts(df.agg(count_matches(keywords, text).alias("counts")), keywords)
    return counts.where(F.col("series") != ALL).withColumnRenamed("series", "keyword")


def counts_by_time(df: DataFrame, ts="dateTweet") -> DataFrame:
    """Posts per exact time, in time order."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts"))
    return sort_by_time(counts.agg(F.count(F.lit(1)).alias("n")))


def minute_span(df: DataFrame, ts="dateTweet") -> DataFrame:
    """One row: number of distinct minutes and the newest one."""
    return df.agg(
        F.countDistinct(minute(ts)).alias("minutes"), F.max(minute(ts)).alias("newest")
    )


def minute_counts_closed(df: DataFrame, ts="dateTweet") -> DataFrame:
    """Posts per minute in time order, without the newest minute."""
    counts = (
        df.where(F.col(ts).isNotNull()).groupBy(minute(ts).alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    newest = df.agg(minute(F.max(ts))).scalar()
    return sort_by_time(counts.where(F.col("ts") < newest))


def keep_last(series: DataFrame, n: int = 100, by: Sequence[str] = ("series",)) -> DataFrame:
    """The newest ``n`` buckets of each series.

    Spark cuts every partition to ``n`` rows per series before the shuffle.
    """
    newest_first = W.partitionBy(*by).orderBy(F.desc("ts"))
    ranked = series.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def sort_by_time(df: DataFrame, ts="ts") -> DataFrame:
    return df.orderBy(ts)


def first_keywords(keywords: DataFrame, n: int) -> DataFrame:
    """The first ``n`` keywords of an ordered keyword table."""
    return keywords.where(F.col("pos") < n)


def append_increment(state: DataFrame, increment: DataFrame) -> DataFrame:
    """Old series followed by new buckets."""
    return state.unionByName(increment)


def update_series(
    state: DataFrame, snapshot: DataFrame, keep: int = 100, by: Sequence[str] = ("series",)
) -> DataFrame:
    """Refresh: append the snapshot's buckets newer than the state, keep the last ``keep``.

    "Newer" is measured against the newest bucket of ``All`` in the state, of each audience by
    itself where ``by`` names more than the series; an empty state accepts everything.
    ``state`` and ``snapshot`` are (…, series, ts, n).
    """
    groups = [c for c in by if c != "series"]
    newest = state.where(F.col("series") == ALL)
    if not groups:
        newer = newer_than(snapshot, newest.agg(F.max("ts")).scalar())
    else:
        last = newest.groupBy(*groups).agg(F.max("ts").alias("_last"))
        met = snapshot.join(last, groups, "left").select(*snapshot.columns, "_last")
        newer = newer_than(met, F.col("_last")).drop("_last")
    return keep_last(append_increment(state, newer), keep, by)


def series_change(
    state: DataFrame, snapshot: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """(changed, last): whether ``All`` gained a bucket, and its newest one.

    One row, or one for each value of the columns ``by``.
    """
    of_all = F.col("series") == ALL
    if not by:
        held = state.where(of_all).agg(F.max("ts")).scalar()
        new = snapshot.where(of_all).agg(F.max("ts").alias("_new")).withColumn("_held", held)
    else:
        held = state.where(of_all).groupBy(*by).agg(F.max("ts").alias("_held"))
        new = snapshot.where(of_all).groupBy(*by).agg(F.max("ts").alias("_new"))
        new = new.join(held, list(by), "full")
    gained = F.col("_held").isNull() & F.col("_new").isNotNull() | (F.col("_new") > F.col("_held"))
    return new.select(
        *by, F.coalesce(gained, F.lit(False)).alias("changed"),
        F.greatest("_new", "_held").alias("last"),
    )
