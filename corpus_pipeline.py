"""A corpus pipeline: language, exact copies, near copies, source mix, packing.

Every stage takes null keys and texts, repeated rows, ties, empty tables and columns of any name; all but
the last give the columns of their input, in order. What each does with these cases stands below and
in full at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postpulse.llm import exact, language, mixing, packing, simhash
from postpulse.llm.catalog import REST, WEIGHTS
from postpulse.llm.common import fresh, named, written

#: SQL for run()'s rows: the language models and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null texts, and those without any letter.

    Rows are judged each, repeated ones and null keys too. Where ``lang`` is null throughout no
    language is learned and all go.
    """
    return language.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest, then that of the smallest key.

    Null texts count as empty ones; a null key stays only if no other is as long; rows equal in key and
    text become one.
    """
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest key, null keys last.

    Documents without words are one group. Of several texts of one key that of the smallest digest
    stays; rows equal in key and text become one.
    """
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come to their target shares.

    Null and unlisted sources share one weight. A null key is known by its text; repeated rows of a key
    are repeated alike. A column ``copy`` of the input stays as it was.
    """
    copy = fresh(docs, "copy")
    return mixing.replicate(docs, WEIGHTS, rest=REST, copy=copy).select(*map(named, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null texts are empty, and each row is a document of its own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
