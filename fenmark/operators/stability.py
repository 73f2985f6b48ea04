"""Stability of a cell's class over time: the commonest classes, entropy, and a decision category.

One aggregate by (key, class), then one by key; all combinations of division, attempt and pixel go through one job by
making them part of the key. A cell with a missing observation has no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pair_number

#: Thresholds by name.
LIMITS = {"true_winner_min": 0.8, "med_winner_min": 0.7, "majority_min": 0.6, "tie_min": 0.4}


def decision_category(first: Column, second: Column, limits: dict[str, float] | None = None) -> Column:
    """1 clear winner, 2 moderate winner, 3 majority, 4 tie of two, 5 none; null without a first frequency.

    The later of these tests wins: majority, moderate, tie (both frequencies above tie_min), clear.
    """
    m = LIMITS | (limits or {})
    chain = F.when(first.isNull(), None).when(first >= m["true_winner_min"], 1)
    chain = chain.when((first > m["tie_min"]) & (second > m["tie_min"]), 4)
    return chain.when(first >= m["med_winner_min"], 2).when(first >= m["majority_min"], 3).otherwise(5)


def class_counts(obs: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """keys, cls and sp_c; cells with a null class are left out whole."""
    counted = obs.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("sp_c"))
    missing = F.max(F.when(F.col(cls).isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys))
    return counted.withColumn("sp_missing", missing).filter("sp_missing = 0").drop("sp_missing")


def stability_profile(obs: DataFrame, keys: list[str], cls: str = "class", limits: dict[str, float] | None = None, digits: int = 9) -> DataFrame:
    """keys, modal_class, modal_frequency, second_class, second_frequency, entropy_normalized and decision_category.

    Of equally common classes the least comes first. Entropy is divided by the logarithm of the number of classes that the cell
    has; with one class it is 0. Without a second class its frequency is 0.
    """
    by = Window.partitionBy(*keys)
    counted = class_counts(obs, keys, cls)
    ranked = counted.select(*keys, cls, "sp_c", F.row_number().over(by.orderBy(F.desc("sp_c"), cls)).alias("sp_rn"), F.sum("sp_c").over(by).alias("sp_n"), F.count(F.lit(1)).over(by).alias("sp_k"))
    p = F.col("sp_c") / F.col("sp_n").cast("double")
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("sp_rn") == 1, F.col(cls))).alias("modal_class"),
        F.max(F.when(F.col("sp_rn") == 1, p)).alias("modal_frequency"),
        F.max(F.when(F.col("sp_rn") == 2, F.col(cls))).alias("second_class"),
        F.coalesce(F.max(F.when(F.col("sp_rn") == 2, p)), F.lit(0.0)).alias("second_frequency"),
        F.when(F.max("sp_k") == 1, 0.0).otherwise(F.round(-F.sum(p * F.log2(p)) / F.log2(F.nullif(F.max("sp_k"), F.lit(1))), digits)).alias("entropy_normalized"),
    )
    return out.withColumn("decision_category", decision_category(F.col("modal_frequency"), F.col("second_frequency"), limits))


def value_percentages(df: DataFrame, value: str, keys: list[str] | None = None, digits: int = 2) -> DataFrame:
    """keys, value, n and percentage of the non-null values of a key, half to even."""
    keys = keys or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percentage", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), digits))


def unstable_pairs(profile: DataFrame, keys: list[str], palette: int = 22) -> DataFrame:
    """Cells of category 4 with their two classes in order and a palette number, and cells of category 5."""
    pair = F.array_sort(F.array(F.col("modal_class").cast("string"), F.col("second_class").cast("string")))
    tie = F.col("decision_category") == 4
    return profile.filter("decision_category in (4, 5)").select(*keys, "decision_category", F.when(tie, F.array_join(pair, "_")).alias("pair"), F.when(tie, pair_number(F.col("modal_class"), F.col("second_class"), palette)).alias("palette"))


def stable_cells(profile: DataFrame, colours: DataFrame, keys: list[str], categories: list[int], alpha: dict[int, float] | None = None) -> DataFrame:
    """keys, colour of the modal class (colours: class, color) and alpha, for cells of the given categories."""
    shade = F.lit(1.0)
    for k, v in (alpha or {}).items():
        shade = F.when(F.col("decision_category") == k, v).otherwise(shade)
    return profile.filter(F.col("decision_category").isin(categories)).join(colours, F.col("modal_class") == F.col("class"), "left").select(*keys, "modal_class", F.coalesce("color", F.lit("#000000")).alias("color"), shade.alias("alpha"))
