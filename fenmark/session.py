"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "fenmark") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodata_to_null(value: Column, nodata: float) -> Column:
    """A sentinel or a not-a-number becomes null; only sinks write sentinels again."""
    return F.when((value == F.lit(nodata)) | F.isnan(value.cast("double")), None).otherwise(value)
