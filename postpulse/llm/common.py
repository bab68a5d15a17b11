"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.session import in_tasks, shared_dir  # noqa: F401

SPACES = b" \t\n\x0b\x0c\r"


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """``stem``, or a name made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (binary) has about ``limit`` bytes in each.

    A row is never cut, so one very long text may exceed the limit by itself.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(offsets_of(values)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(values: pa.Array) -> np.ndarray:
    """Byte offsets of a binary array."""
    values = values.cast(pa.large_binary())
    raw = np.frombuffer(values.buffers()[1], np.int64)
    return raw[values.offset: values.offset + len(values) + 1]


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a binary array as one byte array, and the ends of each in it; null is empty."""
    texts = [v or b"" for v in values.to_pylist()]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends
