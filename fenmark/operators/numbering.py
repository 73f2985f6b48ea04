"""Row numbers over a whole table without one task sorting it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str | Column], name: str = "n", bins: int | None = None) -> DataFrame:
    """df with numbers from 1 in the order given: range partitions are numbered alone and offset by the sizes before.

    bins: as many as the session has shuffle partitions, unless given. The order should be total; equal rows are numbered
    in any order. The ranges are a checkpoint in the shared folder, so that both reads see the same ones even if an
    executor is lost between them. An empty table gives no rows.
    """
    from .grid import ensure_checkpoint_dir

    ensure_checkpoint_dir(df)
    bins = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(bins, *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("nb_part", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("nb_part").agg(F.count(F.lit(1)).alias("nb_size"))
    before = sizes.select("nb_part", (F.sum("nb_size").over(Window.orderBy("nb_part")) - F.col("nb_size")).alias("nb_before"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("nb_part").orderBy(*order))
    return placed.withColumn("nb_row", inside).join(before, "nb_part").withColumn(name, (F.col("nb_before") + F.col("nb_row")).cast("long")).drop("nb_part", "nb_row", "nb_before")
