"""The stand-ins built from the driver tables."""

from pyspark.sql import functions as F

from postpulse.plans import catalog
from postpulse.plans.tables import Tables


def test_texts_are_met_without_one_key_for_most_posts(spark, tmp_path):
    spark.range(100).selectExpr("id doc_id", "'d' || id text", "'es' lang", "'s' source").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.range(300).selectExpr("id % 100 conv_id", "id div 100 turn", "'user' role", "'c' || id text").write.parquet(
        f"{tmp_path}/conversations.parquet")
    kept = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(kept, ("-1", "false", "8"), strict=True):
            spark.conf.set(key, value)
        posts = spark.range(0, 4_000, 1, 4).withColumnRenamed("id", "ingest_id")
        placed = Tables(spark, str(tmp_path)).with_text(posts)
        found = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in found) < 1_600
        texts = {r["ingest_id"]: r["tweet"] for r in placed.where("ingest_id < 220").collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(texts) == 220
    assert [texts[i] for i in (0, 10, 210)] == ["d0", "d1", "d21"]
    assert [texts[i] for i in (1, 101, 219)] == ["c1", "c101", "c219"]


def test_a_stream_meets_many_texts_in_more_tasks(spark, tmp_path):
    """Spark's number of tasks for a stream is fixed; each would hold more with more texts."""
    spark.range(0, 100, 1, 4).selectExpr("id doc_id", "'d' || id text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 300, 1, 4).selectExpr("id % 100 conv_id", "id div 100 turn", "'c' || id text").write.parquet(
        f"{tmp_path}/conversations.parquet")
    spark.range(400).withColumnRenamed("id", "ingest_id").write.parquet(f"{tmp_path}/posts")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.openCostInBytes")}
    met = []

    def meet(batch, _):
        met.append((batch.rdd.getNumPartitions(), {r["ingest_id"]: r["tweet"] for r in batch.collect()}))

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a split for each file
        stream = spark.readStream.schema("ingest_id long").parquet(f"{tmp_path}/posts")
        run = Tables(spark, str(tmp_path)).with_text(stream).writeStream.foreachBatch(meet).option(
            "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    (tasks, texts), = met
    assert tasks == 32
    assert len(texts) == 400
    assert [texts[i] for i in (0, 10, 1, 101, 219)] == ["d0", "d1", "c1", "c101", "c219"]


def test_the_feed_is_packed_and_whole(spark, tmp_path, monkeypatch):
    spark.range(10).selectExpr("id doc_id", "'migaja ' || id text", "'es' lang", "'s' source").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.range(10).selectExpr("id conv_id", "0L turn", "'user' role", "'c' || id text").write.parquet(
        f"{tmp_path}/conversations.parquet")
    spark.range(0, 40, 1, 2).selectExpr(
        "id event_id", "timestamp'2024-01-02 03:04:05' ts", "0L user_id", "'{}' props", "1d value",
        "if(id % 4 = 0, 'error', 'view') event_type").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "shared_dir", lambda _, label: f"{tmp_path}/{label}")
    monkeypatch.setattr(catalog, "FEED_LINES", 7, raising=False)
    stored = catalog.queries()["ingest_posts"](spark, str(tmp_path))
    # Tenth posts have a document; of these every second one is an error.
    assert sorted(r["tweet"] for r in stored.collect()) == ["#view migaja 1", "#view migaja 3"]
    files = [p for p in (tmp_path / "ingest" / "feed").iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".txt.gz") for p in files)
    lines = [spark.read.text(str(p)).count() for p in files]
    assert sum(lines) == 50 and max(lines) <= 7
