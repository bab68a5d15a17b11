"""Parameter files: keywords, rosters, stop words; and news articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.text import strip_accents, strip_first
from postpulse.schemas import NEWS
from postpulse.sources.framing import json_elements


def split_keywords(df: DataFrame, col="value") -> DataFrame:
    """One text per row -> (pos, keyword), order kept."""
    return df.select(F.posexplode(F.split(col, ", ")).alias("pos", "keyword"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Ordered keyword table from a one-line file separated by ``', '``."""
    return split_keywords(spark.read.text(path, wholetext=True))


def roster_handles(df: DataFrame, col: str, strict: bool = True) -> DataFrame:
    """Rows with a handle, plus ``handle`` without the first character.

    ``strict=True`` drops that character whatever it is, so ``' @a'`` keeps its
    ``@``. ``strict=False`` trims blanks and drops the ``@`` only if there is one.
    """
    listed = df.where(F.col(col).isNotNull())
    if strict:
        return listed.withColumn("handle", strip_first(col))
    return listed.withColumn("handle", F.regexp_replace(F.trim(col), "^@", ""))


def read_roster(
    spark: SparkSession, path: str, col: str, strict: bool = True
) -> DataFrame:
    """Roster CSV with a header -> its rows that have a handle in column ``col``."""
    rows = spark.read.options(header="true", quote='"', escape='"').csv(path)
    return roster_handles(rows, col, strict)


def plain_stopwords(df: DataFrame, col="value") -> DataFrame:
    """(word): distinct words without accents."""
    return df.select(strip_accents(col).alias("word")).distinct()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Stop-word table from a file with one word per line."""
    return plain_stopwords(spark.read.text(path))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News articles from files that each hold one JSON array.

    A file is read in its splits, by as many tasks: arrays may be of any size and need no line breaks.
    """
    found = json_elements(spark, path)
    return found.select(F.from_json("record", NEWS).alias("article")).select("article.*")
