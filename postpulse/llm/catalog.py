"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import (
    collocations,
    conversations,
    exact,
    language,
    line_rules,
    mixing,
    packing,
    quality,
    search,
    sharding,
    simhash,
    substrings,
    urls,
)
from postpulse.llm.common import table

#: Target shares of the sources: equal ones.
WEIGHTS = {f"src{i}": 1.0 for i in range(20)}
#: Target share of all documents whose source is null or not named above, together.
REST = 1.0
#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.replicate(table(spark, folder, "documents"), WEIGHTS, rest=REST)


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_id(table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), rules)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.judged(conversations.damage(rows), rows)


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.top_phrases(table(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = line_rules.clean_lines(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup, op2_exact_dedup, op3_quality_classifier, op4_exact_top_k,
        op5_source_mixing, op6_simhash_near_dedup, op7_language_id, op8_sharding,
        op9_url_filters, op10_packing, op11_conversation_repair, op12_phrase_collocations,
        op13_quality_rules,
    )
    return {f.__name__: f for f in found}
