"""URL filters: host-suffix and path-prefix expressions joined with rules on hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import fresh, named

PREFIX = 8  # hex digits of the digest that the join compares
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, with A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(url, _HOST, 1)
    return F.coalesce(
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")
    )


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """A URL's host suffixes of so many labels with its path prefixes of so many characters."""
    made = [
        F.when(F.length("path") >= length,
               F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))
        for labels, length in shapes
    ]
    return F.array_compact(F.array_distinct(F.array(*made)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
          keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The rule and the verdict of every URL.

    ``rules`` has the string columns host, path and verdict. A rule fits its host and all
    subdomains if the URL's path starts with the rule's. Of those that fit the longest
    ``host || path`` wins, then the longer host, then ``block`` before ``allow``. ``default`` is the
    verdict where none fits (rule is then null).

    Each distinct (host, path) is judged once, so a URL that fills a third of the table is
    aggregated before it is shuffled. Expressions are made only for the shapes (labels of
    the host, characters of the path) that occur among the rules; the shapes are the only
    thing collected, at most 127 labels by the longest path. The equi-join compares the first hex
    digits of SHA-256 digests, then the full digests are compared.

    Output: the columns ``keep``, then host, path, rule, verdict, one row per row of ``pages``;
    repeated rows and null ids are kept. Null URL or none with ``://``: host and path are
    empty. Rules with a null or empty host fit nothing; a null path is an empty one. No
    rules or no pages: defined as above. Other columns of either table are not read.
    """
    split = pages.select(*map(named, keep), host_of(named(url)).alias(h := fresh(pages, "host")),
                         path_of(named(url)).alias(p := fresh(pages, "path")))
    usable = rules.where(F.length("host") > 0).select(
        "host", F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).distinct()
    shaped = usable.select(F.size(F.split("host", r"\.")), F.length("path")).distinct()
    shapes = [tuple(r) for r in shaped.collect()]
    expression = F.concat("host", "path")
    keyed = usable.select(
        F.sha2(expression, 256).alias("digest"),
        F.substring(F.sha2(expression, 256), 1, PREFIX).alias("short"),
        F.struct(
            F.length(expression).alias("size"), F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"), expression.alias("rule"), "verdict",
        ).alias("won"),
    )
    pairs = split.select(named(h).alias("host"), named(p).alias("path")).distinct()
    if shapes:
        asked = pairs.select("host", "path", F.explode(_expressions(shapes)).alias("x")).select(
            "host", "path", F.sha2("x", 256).alias("asked"))
        asked = asked.withColumn("short", F.substring("asked", 1, PREFIX))
        met = asked.join(keyed, "short").where(F.col("asked") == F.col("digest"))
    else:
        won = F.lit(None).cast(keyed.schema["won"].dataType)
        met = pairs.where(F.lit(False)).withColumn("won", won)
    best = met.groupBy("host", "path").agg(F.max("won").alias("won"))
    best = best.select("host", "path", "won.rule", "won.verdict")
    left = split.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)],
                        named(h).alias("host"), named(p).alias("path"))
    told = left.join(best, ["host", "path"], "left")
    return told.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
