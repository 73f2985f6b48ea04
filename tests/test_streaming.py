from pyspark.sql import functions as F

from fenmark.streaming import periods


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = periods.period_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("periods").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r["class"]): r.n for r in spark.table("periods").collect()}
    batch = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("class")).count()
    assert got == {(r.start, r["class"]): r["count"] for r in batch.collect()}


def test_repeats_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "k int, ts string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = periods.first_seen(stream, "k").writeStream.outputMode("append").format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]
