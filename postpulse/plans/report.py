"""Chart-ready tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.constants import CHARTED, TOP_WORDS
from postpulse.operators.filters import positive_only
from postpulse.operators.series import ALL, EVERYONE, keyword_series, keyword_totals
from postpulse.operators.words import document_frequency, top_words


def _charted(series: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return series.where(F.col("series").isin([ALL, *keywords]))


def chart_series(
    series: DataFrame, keywords: Sequence[str], charted: int | None = CHARTED
) -> DataFrame:
    """Points of the first ``charted`` keywords (``None``: of all) and ``All``, in plotting order."""
    order = [c for c in ("audience", "series", "ts") if c in series.columns]
    return _charted(series, list(keywords)[:charted]).orderBy(*order)


def keyword_weights(series: DataFrame) -> DataFrame:
    """Total of each keyword that occurs at all."""
    return positive_only(keyword_totals(series.where(F.col("series") != ALL)))


def word_weights(
    df: DataFrame, n: int = TOP_WORDS, stopwords: Sequence[str] | DataFrame = (), text="tweet"
) -> DataFrame:
    """The ``n`` words found in most posts."""
    return top_words(document_frequency(df, stopwords, text), n)


def mark_listed(
    df: DataFrame, rosters: Mapping[str, DataFrame], on="screenName", handle="handle"
) -> DataFrame:
    """Add a true/null column ``in_<name>`` per roster.

    Each roster is joined once, unhinted: Spark broadcasts it when its measured
    size allows, else hot authors are split by the adaptive skew join.
    """
    for name, roster in rosters.items():
        listed = roster.select(F.col(handle).alias(on)).distinct()
        df = df.join(listed.withColumn(f"in_{name}", F.lit(True)), on, "left")
    return df


def dashboard(
    df: DataFrame,
    keywords: Sequence[str],
    rosters: Mapping[str, DataFrame],
    stopwords: Sequence[str] | DataFrame = (),
    words: int = TOP_WORDS,
    edge: str = "series",
    ts="dateTweet",
    text="tweet",
    on="screenName",
    charted: int | None = CHARTED,
) -> DataFrame:
    """(audience, part, name, ts, n) for everyone and each roster.

    ``part`` is ``series`` (points of the first ``charted`` keywords, ``None``: of all) or
    ``weight``: word weights for everyone, keyword weights for rosters. The series of all audiences come from one pass over
    the posts and one shuffle of minute rows; word counting is the second pass.
    """
    marked = mark_listed(df.select(ts, text, on), rosters, on)
    audiences = {EVERYONE: F.lit(True), **{name: F.col(f"in_{name}") for name in rosters}}
    series = keyword_series(marked, keywords, ts, text, edge, audiences)
    # Points and totals in one aggregate, so the posts are not counted once for each; only what
    # is asked for reaches it.
    point = F.when(F.col("series").isin([ALL, *list(keywords)[:charted]]),
                   F.struct(F.lit("series").alias("part"), "ts"))
    total = F.when((F.col("audience") != EVERYONE) & (F.col("series") != ALL),
                   F.struct(F.lit("weight").alias("part"), F.lit(None).cast("timestamp").alias("ts")))
    pieces = series.select("audience", F.col("series").alias("name"), "n",
                           F.inline(F.array_compact(F.array(point, total))))
    activity = pieces.groupBy("audience", "part", "name", "ts").agg(F.sum("n").alias("n")).where(
        (F.col("part") == "series") | (F.col("n") > 0))
    everyone = word_weights(df, words, stopwords, text).select(
        F.lit(EVERYONE).alias("audience"), F.lit("weight").alias("part"),
        F.col("word").alias("name"), F.lit(None).cast("timestamp").alias("ts"), "n",
    )
    return activity.unionByName(everyone)
