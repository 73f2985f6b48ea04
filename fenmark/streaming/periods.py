"""Period aggregates over a stream of observations, equal to the batch ones once the stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_counts(stream: DataFrame, ts: str = "ts", cls: str = "event_type", period: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, class, n, sum of value by tumbling period; rows that are later than `late` are dropped."""
    timed = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", period), F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "class", "n", "total")


def first_seen(stream: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """One row a key within the watermark: repeats are dropped as they come."""
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
