"""Accuracy of predicted classes: everything comes from one confusion aggregate by (keys, truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round2


def confusion(pairs: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """keys, truth, pred, c; pairs with a null on either side are left out."""
    kept = pairs.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return kept.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("c"))


def _per_class(conf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, tp, n (truth rows), m (predicted rows), for each class on either side."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("c")).otherwise(0)
    t = conf.select(*keys, F.col("truth").alias("class"), hit.alias("tp"), F.col("c").alias("n"), F.lit(0).cast("long").alias("m"))
    p = conf.select(*keys, F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"), F.col("c").alias("m"))
    return t.unionByName(p).groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.sum("m").alias("m"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1() -> Column:
    return _ratio(2 * F.col("tp"), F.col("n") + F.col("m"))


def class_scores(pairs: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """keys, class, precision, recall, f1 (two decimals; null for a class without truth rows) and n."""
    per = _per_class(confusion(pairs, keys, truth, pred), keys)
    some = lambda c: F.when(F.col("n") > 0, round2(c))
    return per.select(*keys, "class", some(_ratio(F.col("tp"), F.col("m"))).alias("precision"), some(_ratio(F.col("tp"), F.col("n"))).alias("recall"), some(_f1()).alias("f1"), F.col("n").cast("long").alias("n"))


def accuracy(pairs: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """keys, n, acc, macro_f1 (over classes on either side) and weighted_f1 (by truth rows), two decimals."""
    per = _per_class(confusion(pairs, keys, truth, pred), keys).withColumn("f1", _f1())
    total = F.sum("n").cast("double")
    return per.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"),
        round2(F.try_divide(F.sum("tp").cast("double"), total)).alias("acc"),
        round2(F.avg("f1")).alias("macro_f1"),
        round2(F.try_divide(F.sum(F.col("f1") * F.col("n")), total)).alias("weighted_f1"),
    )


def wide_scores(scores: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """One row a key with prec_, rec_, f1_ and n_ columns of the given classes."""
    out = scores.groupBy(*keys).pivot("class", classes).agg(F.first("precision").alias("prec"), F.first("recall").alias("rec"), F.first("f1").alias("f1"), F.first("n").alias("n"))
    return out.select(*keys, *[F.col(f"`{c}_{m}`").alias(f"{m}_{c}") for c in classes for m in ("prec", "rec", "f1", "n")])


def weighted_year_average(scores: DataFrame, weights: dict[str, float], year: str, period: str, metrics: list[str], counts: list[str]) -> DataFrame:
    """Per year: metrics averaged with the periods' weights over their non-null values; counts averaged, null as 0."""
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(period)]
    rows = scores.filter(F.col(period).isin(list(weights))).withColumn("w", w.cast("decimal(18,9)"))
    # Sums of decimals are exact, so that a mean on the edge rounds the same way in any order.
    total = lambda c: F.sum(F.col(c).cast("decimal(18,9)") * F.col("w")).cast("double")
    mean = lambda c: round2(F.try_divide(total(c), F.sum(F.when(F.col(c).isNotNull(), F.col("w"))).cast("double"))).alias(c)
    return rows.groupBy(year).agg(*[mean(c) for c in metrics], *[F.bround(F.avg(F.coalesce(F.col(c), F.lit(0))), 0).cast("long").alias(c) for c in counts])


def timeframe_average(scores: DataFrame, timeframe: str, year: str, period: str, metrics: list[str], counts: list[str]) -> DataFrame:
    """Per year of one timeframe: metrics averaged, counts summed."""
    return scores.filter(F.col(period) == timeframe).groupBy(year).agg(*[round2(F.avg(c)).alias(c) for c in metrics], *[F.sum(c).cast("long").alias(c) for c in counts])


def scores_by_class_and_year(scores: DataFrame, year: str, metric: str) -> DataFrame:
    """(class, year, score, n) for a heat map: the mean of a metric, null where n is not positive, and the sum of n."""
    return scores.groupBy("class", year).agg(round2(F.avg(F.when(F.col("n") > 0, F.col(metric)))).alias("score"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def sampled_pairs(points: DataFrame, cells: DataFrame, class_map: dict[str, str], x: str, y: str, truth: str, transform: tuple, nodata: int | None = None) -> DataFrame:
    """points with y_pred: the class of the cell that a point falls into; points outside, on nodata or on an unmapped class go."""
    from ..functions.scalars import row_col

    r, c = row_col(F.col(x), F.col(y), transform)
    names = F.create_map(*[F.lit(v) for kv in class_map.items() for v in kv])
    placed = points.withColumns({"p_row": r, "p_col": c})
    found = placed.join(cells.select(F.col("row").cast("long").alias("p_row"), F.col("col").cast("long").alias("p_col"), F.col("value").alias("p_value")), ["p_row", "p_col"])
    if nodata is not None:
        found = found.filter(F.col("p_value") != nodata)
    return found.withColumn("y_pred", names[F.col("p_value").cast("string")]).filter("y_pred is not null").drop("p_row", "p_col", "p_value")


def share_of_total(df: DataFrame, value: str, keys: list[str]) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*keys))
