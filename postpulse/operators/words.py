"""Word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.text import distinct_words, is_counted, plain_text, split_words


def count_words(words: DataFrame, word="word") -> DataFrame:
    """(word, n). Counts are summed within partitions first, so frequent words do
    not gather in one task."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def document_frequency(
    df: DataFrame, stopwords: Sequence[str] | DataFrame = (), text="tweet"
) -> DataFrame:
    """(word, n): number of posts a word occurs in, after cleaning.

    ``stopwords`` is a list, or a table with the column ``word`` of any size.
    """
    # Texts are cleaned in a step of its own, whose lambda would keep the words out of compiled code.
    # Exploding the expression itself: on a column, the optimiser would add a test for
    # empty arrays at the scan and so clean every text twice.
    cleaned = df.select(plain_text(text).alias("_plain"))
    words = cleaned.select(F.explode(distinct_words("_plain")).alias("word"))
    if isinstance(stopwords, DataFrame):
        counts = count_words(words.where(is_counted(F.col("word"))))
        # Counted words are far fewer than word occurrences, so stop words leave here.
        return counts.join(stopwords.select("word"), "word", "left_anti")
    return count_words(words.where(is_counted(F.col("word"), stopwords)))


def term_frequency(df: DataFrame, text="tweet") -> DataFrame:
    """(word, n): occurrences of raw words split on whitespace, nothing cleaned."""
    words = df.select(F.explode(split_words(text)).alias("word"))
    return count_words(words.where(F.col("word") != ""))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two word counts."""
    return a.unionByName(b).groupBy("word").agg(F.sum("n").alias("n"))


def top_words(counts: DataFrame, n: int = 35) -> DataFrame:
    """The ``n`` most frequent words; equal counts in word order."""
    return counts.orderBy(F.desc("n"), "word").limit(n)
