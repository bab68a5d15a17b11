"""Feed -> stored posts, captures and rejects."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postpulse.constants import REFRESH
from postpulse.operators.filters import with_missing, with_post
from postpulse.operators.project import capture_row, flatten_post
from postpulse.schemas import CAPTURE
from postpulse.sources.captures import WRITE, capture_file, escaped, record_header
from postpulse.sources.posts import passes_live
from postpulse.sources.sinks import by_day

# Of files of JSON lines, which are several times as large as plain text. A higher level takes more time than it saves disk.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def refresh_trigger(period: str | None = REFRESH) -> dict:
    """Trigger options: a period, or everything available now and stop."""
    return {"processingTime": period} if period else {"availableNow": True}


def ingest_stream(
    lines: DataFrame,
    posts: str,
    captures: str,
    rejects: str,
    checkpoint: str,
    live: tuple[Sequence[float], Sequence[str], Sequence[str]] | None = None,
    tz: str | None = None,
    period: str | None = REFRESH,
) -> StreamingQuery:
    """Store every post of a stream of JSON lines (column ``value``).

    Each micro-batch is read and parsed once and judged first: lines that are no usable post go to
    ``rejects`` whatever the filter, in packed files, and never stop the stream. Good posts that pass ``live``,
    (box, languages, tracked words), are stored; without it all are. What is held of a batch while it
    is written are these posts and the rejects, on disk.

    Posts and captures lie in ``day=<day>/feed=<checkpoint>/batch=<id>``. A batch overwrites its
    own folders, so one repeated after a failure leaves no duplicates, and streams with checkpoints
    of their own can share the folders. The folders of a day that is over are put together by
    ``compact_days``, so what has to be listed here doesn't grow with time.
    """
    feed = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = with_missing(with_post(batch))
        good = F.size("missing") == 0
        taken = good & passes_live(*live) if live else good
        # A batch may be the whole feed: of each line only what is written is kept, and on disk.
        kept = judged.select(
            F.when(taken, F.col("_post")).alias("_post"),
            F.when(~good, F.struct("value", "missing")).alias("_bad"),
        ).persist(StorageLevel.DISK_ONLY)

        def put(df: DataFrame, path: str, *by: str, kind: str = "parquet", **options) -> None:
            if by:  # a day of the batch is one file, or several if it is large
                df = df.hint("rebalance", *by)
            marked = df.withColumns({"feed": F.lit(feed), "batch": F.lit(batch_id)})
            (
                marked.write.mode("overwrite").format(kind).options(**options)
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*by, "feed", "batch").save(path)
            )

        try:
            raw = kept.where(F.col("_post").isNotNull()).select("_post.*")
            put(by_day(flatten_post(raw, tz, with_id=True)), posts, "day")
            rows = capture_row(raw, tz)
            put(capture_file(escaped(rows)).withColumn("day", F.to_date("created_at")),
                captures, "day", kind="csv", **WRITE)
            put(kept.where(F.col("_bad").isNotNull()).select("_bad.*"), rejects, kind="json", **PACKED)
        finally:
            kept.unpersist()

    record_header(lines.sparkSession, captures, [f.name for f in CAPTURE.fields])
    return (
        lines.where(F.col("value") != "").select("value").writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**refresh_trigger(period)).start()
    )


def compact_days(spark: SparkSession, landing: str, store: str, before, since=None) -> None:
    """Put the ingested posts of the days before ``before`` into the store, one folder per day.

    ``landing`` is where ``ingest_stream`` or ``append_posts`` leave them.

    Whole days are overwritten, so repeating it leaves the same store. Only the folders of these
    days are listed and read. Busy days are split over several files.
    """
    days = F.col("day") < F.lit(before).cast("date")
    if since is not None:
        days = days & (F.col("day") >= F.lit(since).cast("date"))
    rows = spark.read.parquet(landing).where(days).drop("feed", "batch")
    (
        rows.hint("rebalance", "day").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(store)
    )
