"""Post times against news times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.constants import HISTOGRAM_BINS


def _range(posts: DataFrame, x: str) -> Column:
    """First and last value, and the ends of the bins, looked up in one aggregate.

    The bins of a single value reach half a unit to each side of it.
    """
    first, last = F.min(x), F.max(x)
    pad = F.when(first == last, F.lit(0.5)).otherwise(F.lit(0.0))
    return posts.agg(F.struct(
        first.alias("first"), last.alias("last"),
        (first - pad).alias("lo"), (last + pad).alias("hi"),
    )).scalar()


def _bin_of(x: Column, span: Column, bins: int) -> Column:
    """Bin 1..bins of equal width; the last one includes its right end."""
    place = F.floor((x - span["lo"]) * bins / (span["hi"] - span["lo"])) + 1
    return F.least(place, F.lit(bins)).cast("long")


def time_histogram(posts: DataFrame, bins: int = HISTOGRAM_BINS, x="epoch") -> DataFrame:
    """(bin, lo, hi, n): equal-width histogram of post times, empty bins kept."""
    span = _range(posts, x)
    counts = (
        posts.where(F.col(x).isNotNull())
        .groupBy(_bin_of(F.col(x), span, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (span["hi"] - span["lo"]) / bins
    frame = posts.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    # Both sides have at most ``bins`` rows.
    return (
        frame.join(F.broadcast(counts), "bin", "left")
        .where(span["lo"].isNotNull())
        .select(
            "bin",
            (span["lo"] + (F.col("bin") - 1) * width).alias("lo"),
            (span["lo"] + F.col("bin") * width).alias("hi"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def align_news(
    posts: DataFrame, news: DataFrame, bins: int = HISTOGRAM_BINS, x="epoch"
) -> DataFrame:
    """Articles published within the range of post times, with their bin and its posts."""
    span = _range(posts, x)
    shown = news.where(F.col(x).between(span["first"], span["last"]))
    placed = shown.withColumn("bin", _bin_of(F.col(x), span, bins))
    histogram = time_histogram(posts, bins, x).select("bin", F.col("n").alias("posts"))
    # The histogram has exactly ``bins`` rows.
    return placed.join(F.broadcast(histogram), "bin")
