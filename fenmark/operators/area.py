"""Class shares of area over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fractional_year


def class_shares(cells: DataFrame, keys: list[str], cls: str, class_map: dict[str, str] | None = None) -> DataFrame:
    """keys, class, share: a class's part of all valid cells of a key; with a class map every class of it, 0 where absent.

    Cells of classes that the map lacks count in the denominator only.
    """
    counted = cells.filter(F.col(cls).isNotNull()).groupBy(*keys, F.col(cls).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    shared = counted.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)).cast("double"))
    if class_map is None:
        return shared.select(*keys, F.col("value").alias("class"), "share")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("value"), F.lit(v).alias("class")) for k, v in class_map.items()]))
    wanted = shared.select(*keys).distinct().withColumn("m", named).select(*keys, "m.value", "m.class")
    return wanted.join(shared.select(*keys, "value", "share"), [*keys, "value"], "left").groupBy(*keys, "class").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"))


def quarterly_timeline(shares: DataFrame, year: str, period: str, periods: list[str]) -> DataFrame:
    """shares with t, the middle of the period as a fraction of the year."""
    place = F.array_position(F.array(*[F.lit(p) for p in periods]), F.col(period)) - 1
    return shares.filter(F.col(period).isin(periods)).withColumn("t", fractional_year(F.col(year), place, len(periods)))


def cumulative_shares(shares: DataFrame, keys: list[str], order: str = "class") -> DataFrame:
    """shares with bottom and top of each class's bar when stacked in the order given."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("top", F.sum("share").over(w)).withColumn("bottom", F.col("top") - F.col("share"))
