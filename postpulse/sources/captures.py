"""Capture files: CSV with a header, one post per row.

A capture written here is a folder. Line breaks inside texts are escaped, so its files can be
split, and its header stands in a small record beside it, so reading needs no look into the
files. Files that other programs wrote have line breaks inside quoted text and no record; they are
read in splits as well, by the number of quotes before each line break.
"""

from __future__ import annotations

import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.schemas import CAPTURE, capture_column, capture_header
from postpulse.sources.framing import SPLIT, csv_records

# Quotes are doubled inside quoted text.
_FORMAT = {"header": "true", "quote": '"', "escape": '"'}
# Of foreign files: text may span lines, and an empty field is null.
READ = {**_FORMAT, "multiLine": "true"}
# Of own files: a null is written as \\N, which no escaped text is, so '' stays ''.
WRITE = {
    **_FORMAT, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N", "emptyValue": '""',
}
_READ_OWN = {**_FORMAT, "nullValue": "\\N", "emptyValue": "", "multiLine": "false"}
RECORD = ".header"


def _texts(df: DataFrame, change) -> DataFrame:
    return df.select(*[
        change(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def escaped(df: DataFrame) -> DataFrame:
    """Backslashes doubled and line breaks as ``\\n`` and ``\\r`` in every text column."""
    def change(c: Column) -> Column:
        for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(plain), F.lit(coded))
        return c

    return _texts(df, change)


def unescaped(df: DataFrame) -> DataFrame:
    def change(c: Column) -> Column:
        parts = F.transform(
            F.split(c, r"\\\\"),
            lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
        return F.when(c.contains("\\"), F.array_join(parts, "\\")).otherwise(c)

    return _texts(df, change)


def record_header(spark: SparkSession, path: str, columns: list[str]) -> None:
    """Note the header of the capture at ``path``; a capture has one header for good."""
    line = ",".join(map(capture_header, columns))
    known = _recorded(spark, [path]).get(path.rstrip("/"))
    if known is None:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(
            path.rstrip("/") + RECORD)
    elif known != line:
        raise ValueError(f"the capture at {path} has other columns")


def _recorded(spark: SparkSession, folders: list[str]) -> dict[str, str]:
    """Folder -> header line, for those of the folders that have a record beside them."""
    found = {}
    for parent in sorted({f.rstrip("/").rsplit("/", 1)[0] for f in folders}):
        try:
            lines = spark.read.text(f"{parent}/*{RECORD}").select(
                F.col("_metadata.file_path").alias("file"), "value").collect()
        except AnalysisException:  # no record there
            continue
        for row in lines:
            found[_plain(row["file"]).rsplit("/", 1)[0].removesuffix(RECORD)] = row["value"]
    wanted = {_plain(f): f.rstrip("/") for f in folders}
    return {wanted[k]: v for k, v in found.items() if k in wanted}


def _plain(path: str) -> str:
    """A path without the scheme of the local file system and without escapes."""
    path = unquote(path.rstrip("/"))
    return re.sub("^file:/+", "/", path)


def _within(spark: SparkSession, path: str) -> DataFrame:
    """(folder, header): the records of captures below ``path``; other files' content isn't read."""
    file = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    beside = rf"\Q{RECORD}\E/[^/]+$"
    return lines.where(file.rlike(beside)).select(
        F.regexp_replace(file, beside, "").alias("folder"), F.col("value").alias("header"))


def _foreign(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(path, name): capture files at or below ``path`` that belong to no recorded capture.

    Folders named ``key=value`` belong to what lies above them. Names only, the content is pruned.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv").load(path)
    file = F.col("_metadata.file_path")
    files = listed.select("path", F.regexp_extract(file, "[^/]+$", 0).alias("name"),
                          F.regexp_replace(file, "(/[^/=]+=[^/]*)*/[^/]+$", "").alias("folder"))
    return files.join(recorded.select("folder"), "folder", "left_anti").select("path", "name")


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Header line of each file: a job of one task that reads the beginning of its first split."""
    def first(file: str) -> str | None:
        row = spark.read.text(file).first()
        return row and row[0]

    with ThreadPoolExecutor(8) as pool:
        return {f: line for f, line in zip(files, pool.map(first, files), strict=True)
                if line is not None}


def _columns(header: str) -> T.StructType:
    known = {f.name: f.dataType for f in CAPTURE.fields}
    names = [capture_column(n.strip().strip('"'))
             for n in header.lstrip("\ufeff").rstrip("\r").split(",")]
    return T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])


def _own(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    rows = spark.read.options(**_READ_OWN).schema(schema).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv").csv(folders)
    return unescaped(rows)


def _others(spark: SparkSession, files: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of foreign files, framed in splits, without each file's header."""
    found = csv_records(spark, files)
    rows = found.where(~((F.col(SPLIT) == 0) & (F.col("number") == 0)) & (F.col("record") != ""))
    shape = ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString()
                      for f in schema.fields)
    return rows.select(F.from_csv("record", shape, READ).alias("row")).select("row.*")


def _read_groups(
    spark: SparkSession, own: dict[str, str], others: list[str], headers: dict[str, str] | None = None,
) -> DataFrame:
    """One read for each header, then a union by name. ``own``: folder -> header."""
    told = {_plain(k): v for k, v in (headers or {}).items()}
    lines = {f: told[_plain(f)] for f in others if _plain(f) in told}
    lines |= _first_lines(spark, [f for f in others if f not in lines])
    groups: dict[tuple[bool, str], list[str]] = defaultdict(list)
    for kind, known in ((True, own), (False, lines)):
        for name, header in known.items():
            groups[kind, header.rstrip("\r")].append(name)
    parts = [(_own if kind else _others)(spark, names, _columns(header))
             for (kind, header), names in sorted(groups.items())]
    if not parts:
        return spark.createDataFrame([], CAPTURE)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """One capture with the standard header.

    In captures that other programs wrote, an empty text can't be told from a null and is null.
    """
    if _recorded(spark, [path]):
        return _own(spark, [path], CAPTURE)
    return _others(spark, path, CAPTURE)


def _captures(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Recorded captures at or below ``path`` (folder -> header), and the other files."""
    inner = _within(spark, path)
    own = {unquote(r["folder"]): r["header"] for r in inner.collect()}  # one row for each capture
    beside = _recorded(spark, [path])
    return own | beside, spark.createDataFrame([], "path string, name string") if beside \
        else _foreign(spark, path, inner)


def read_captures(
    spark: SparkSession, path: str, headers: dict[str, str] | None = None
) -> DataFrame:
    """All captures at or below ``path`` as one table, columns matched by name.

    CSV columns are matched by position within a read, so captures are grouped by header: one read
    each, then a union by name. Missing columns become null, unknown ones stay as text. Headers
    come from the records that the writers leave, one for a whole folder; ``headers`` gives those of
    files of other programs by path, and of the rest the first line is read. Files of other programs
    are read in splits too, with the line breaks of their texts.
    """
    own, others = _captures(spark, path)
    return _read_groups(spark, own, [r["path"] for r in others.sort("path").collect()], headers)


def union_captures(*captures: DataFrame) -> DataFrame:
    """All rows of all captures, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), captures)


def latest_capture(spark: SparkSession, path: str) -> DataFrame:
    """The newest capture, all its files. Names carry the start time, so the highest is newest.

    The driver gets one row for each recorded capture, and one of all other files.
    """
    own, others = _captures(spark, path)
    best = others.agg(F.max_by("path", "name").alias("path"), F.max("name").alias("name")).first()
    last = max(own, key=lambda f: f.rsplit("/", 1)[-1], default=None)
    if best["name"] is not None and (last is None or best["name"] > last.rsplit("/", 1)[-1]):
        return _read_groups(spark, {}, [best["path"]])
    return _read_groups(spark, {last: own[last]} if last else {}, [])


def capture_file(df: DataFrame) -> DataFrame:
    """Capture columns under the names of the file header."""
    return df.toDF(*[capture_header(c) for c in df.columns])


def write_capture(df: DataFrame, path: str) -> None:
    """Append capture rows to the capture at ``path``; every file gets the header once."""
    record_header(df.sparkSession, path, df.columns)
    capture_file(escaped(df)).write.mode("append").options(**WRITE).csv(path)


def stream_capture(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Append capture rows of a stream; exactly once through the file sink."""
    record_header(df.sparkSession, path, df.columns)
    return (
        capture_file(escaped(df)).writeStream.format("csv").options(**WRITE)
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def write_combined(df: DataFrame, path: str) -> None:
    """All captures as one table of CSV files under one header.

    Written in parallel as many files; nothing is forced through one task.
    """
    record_header(df.sparkSession, path, df.columns)
    capture_file(escaped(df)).write.mode("overwrite").options(**WRITE).csv(path)
