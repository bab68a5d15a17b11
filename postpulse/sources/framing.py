"""Records that may run over line and split borders, framed in parallel.

A file is read in its splits as pieces between separators. Whether a record ends behind a piece depends
on all that stands before it (inside quotes? how deep in brackets?), which is a running sum within
a split and, of one row per split, over the splits of a file. So a file of any size is framed by
as many tasks as it has splits. A split's pieces meet once, by file and split.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILE, SPLIT, AT, PIECE = "_file", "_split", "_at", "_piece"
TASK = 16 << 20  # bytes of small splits that one task reads, one split after the other


def pieces(spark: SparkSession, paths: str | list[str], separator: str, **options) -> DataFrame:
    """(file, split, place, piece) of text files cut at ``separator``, which the pieces don't hold.

    A split is known by the byte at which it starts. Places rise within a split. Splits far smaller
    than TASK are read several in a task, which costs more to start than such a split to read.
    """
    cut = spark.read.options(lineSep=separator, **options).text(paths).select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(SPLIT),
        F.monotonically_increasing_id().alias(AT), F.col("value").alias(PIECE))
    together = TASK // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if together <= 1:
        return cut
    splits = cut.rdd.getNumPartitions()
    tasks = max(-(-splits // together), 3 * spark.sparkContext.defaultParallelism)
    return cut.coalesce(tasks) if tasks < splits else cut


def _bytes(size: str) -> int:
    """A size as settings write it: a number, perhaps with a unit."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "_kmgtp".index(unit or "_")


def running(amount: Column) -> Column:
    """Sum of ``amount`` over the pieces of the split up to this one."""
    order = W.partitionBy(FILE, SPLIT).orderBy(AT)
    return F.sum(amount).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))


def carried(amount: Column) -> Column:
    """Sum of ``amount`` over the earlier splits of a file, in a frame of one row for each split."""
    earlier = W.partitionBy(FILE).orderBy(SPLIT).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def framed(ended: DataFrame, separator: str, whole: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, split, number, record): records in the order of ``split`` and ``number``.

    ``ended`` has the columns of ``pieces`` and ``ends``: whether a record ends behind the piece. A record
    is its pieces joined by ``separator``. It is counted to the split in which it begins. What
    stands behind a file's last end is a record too where ``whole`` (of the record) holds.

    Almost all records lie within a split and need no further exchange. Only what a split's borders
    cut, two rows of each split at most, is joined over the splits of a file.
    """
    closed = F.col("ends").cast("long")
    number = running(closed) - closed
    parts = ended.select(FILE, SPLIT, AT, PIECE, "ends", number.alias("number"))
    made = parts.groupBy(FILE, SPLIT, "number").agg(
        F.sort_array(F.collect_list(F.struct(AT, PIECE))).alias("run"), F.max("ends").alias("ends"))
    made = made.select(FILE, SPLIT, "number", "ends", F.array_join(
        F.transform("run", lambda r: r[PIECE]), separator).alias("record"))
    # The first record of a split may have begun in an earlier one; the last may not have ended.
    inner = made.where("ends AND number > 0").select(FILE, SPLIT, "number", "record")
    border = made.where("NOT ends OR number = 0")
    order = W.partitionBy(FILE).orderBy(SPLIT, "number")
    stopped = F.col("ends").cast("long")
    group = F.sum(stopped).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - stopped
    joined = border.withColumn("group", group).groupBy(FILE, "group").agg(
        F.sort_array(F.collect_list(F.struct(SPLIT, "number", "record"))).alias("run"),
        F.max("ends").alias("ends"))
    rest = joined.select(
        FILE, F.col("run")[0][SPLIT].alias(SPLIT), F.col("run")[0]["number"].alias("number"), "ends",
        F.array_join(F.transform("run", lambda r: r["record"]), separator).alias("record"))
    kept = F.col("ends") if whole is None else F.col("ends") | whole(F.col("record"))
    return inner.union(rest.where(kept).select(FILE, SPLIT, "number", "record"))


def count_of(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("long")


def csv_records(spark: SparkSession, paths: str | list[str], quote: str = '"', **options) -> DataFrame:
    """(file, split, number, record): records of CSV files, with the line breaks of quoted fields.

    Quotes stand around whole fields and are doubled inside them, so a line break ends a record
    if the quotes before it are even in number. A record that a file leaves open is taken too, empty
    ones aren't. A line feed ends a record; a carriage return before it belongs to it.
    """
    lines = pieces(spark, paths, "\n", **options).withColumn("odd", count_of(F.col(PIECE), quote) % 2)
    splits = lines.groupBy(FILE, SPLIT).agg(F.sum("odd").alias("odd"))
    splits = splits.select(FILE, SPLIT, carried(F.col("odd")).alias("before"))
    met = lines.join(splits, [FILE, SPLIT])
    ended = met.withColumn("ends", (running(F.col("odd")) + F.col("before")) % 2 == 0)
    found = framed(ended, "\n", lambda r: r != "")
    return found.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def json_elements(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """(file, split, number, record): the objects of files that each hold one JSON array.

    Files are cut at ``}``, which ends every object. Whether it stands in a string is told by the
    quotes before it, and whether it closes an element by the depth of brackets outside of strings;
    both are carried over pieces and splits. Line breaks play no part. Elements that are no
    objects belong to the next one.
    """
    bare = F.regexp_replace(F.col(PIECE), r"(?s)\\.", "")  # escapes only stand in strings
    cut = pieces(spark, paths, "}", **options).withColumn("bare", bare)
    outside = lambda text: F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")

    def depth(text: Column, opened: Column) -> Column:
        ups = count_of(text, "[") + count_of(text, "{")
        downs = count_of(text, "]") + count_of(text, "}")
        return ups - downs - F.when(opened, F.lit(0)).otherwise(F.lit(1))  # the } behind the piece

    odd = count_of(F.col("bare"), '"') % 2
    marked = cut.withColumn("odd", odd).select(
        FILE, SPLIT, AT, PIECE, "odd",
        depth(outside(F.col("bare")), F.col("odd") == 1).alias("if_out"),
        depth(outside(F.concat(F.lit('"'), F.col("bare"))), F.col("odd") == 0).alias("if_in"))
    swap = lambda inside: F.when(inside, F.col("if_in")).otherwise(F.col("if_out"))
    # A split's change of depth, whether it begins outside of a string or inside.
    inside = (running(F.col("odd")) - F.col("odd")) % 2 == 1
    sums = marked.drop(PIECE).withColumn("inside", inside).groupBy(FILE, SPLIT).agg(
        F.sum("odd").alias("odd"), F.sum(swap(F.col("inside"))).alias("out"),
        F.sum(swap(~F.col("inside"))).alias("in"))
    begun = sums.withColumn("begins", carried(F.col("odd")) % 2)
    change = F.when(F.col("begins") == 1, F.col("in")).otherwise(F.col("out"))
    begun = begun.withColumn("change", change).select(
        FILE, SPLIT, "begins", carried(F.col("change")).alias("depth"))
    met = marked.join(begun, [FILE, SPLIT])
    before = (running(F.col("odd")) - F.col("odd") + F.col("begins")) % 2 == 1
    met = met.withColumn("before", before).withColumn("step", swap(F.col("before")))
    after = (F.col("before").cast("int") + F.col("odd")) % 2
    ended = met.withColumn("ends", (after == 0) & (running(F.col("step")) + F.col("depth") == 1))
    found = framed(ended, "}")
    return found.withColumn("record", F.concat(
        F.regexp_replace("record", r"^[\s,\[\x{FEFF}]+", ""), F.lit("}")))
