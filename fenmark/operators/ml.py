"""Classification of cells with a random forest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_rows(cells: DataFrame, bands: list[str], valid: Column | None = None) -> DataFrame:
    """Cells whose bands are all finite and, if a condition is given, valid."""
    fine = F.lit(True)
    for b in bands:
        v = F.col(b).cast("double")
        fine = fine & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return cells.filter(fine if valid is None else fine & valid)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: n / (classes * rows of the class), so that classes count alike."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    weighed = per.withColumn("weight", F.sum("c").over(Window.partitionBy(F.lit(0))) / (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * F.col("c")))  # a row for each class
    return rows.join(weighed.select(label, "weight"), label)


def train_forest(rows: DataFrame, bands: list[str], label: str, trees: int = 500, seed: int = 42, depth: int = 12) -> PipelineModel:
    """Labels are numbered in alphabetical order; classes are balanced by weight."""
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"), VectorAssembler(inputCols=bands, outputCol="features"), RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed, maxDepth=depth)]
    return Pipeline(stages=stages).fit(class_weights(usable_rows(rows, bands), label))


def predict(model: PipelineModel, cells: DataFrame, bands: list[str]) -> DataFrame:
    """cells with pred (a label; null where a band is missing) and probability of it."""
    labels = model.stages[0].labels
    keys = [c for c in cells.columns]
    fine = usable_rows(cells, bands)
    assembled = model.stages[2].transform(model.stages[1].transform(fine))
    names = F.array(*[F.lit(x) for x in labels])
    done = assembled.select(*keys, names[F.col("prediction").cast("int")].alias("pred"), F.array_max(vector_to_array("probability")).alias("probability"))
    bad = F.lit(False)
    for b in bands:
        v = F.col(b).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rest = cells.filter(F.coalesce(bad, F.lit(True))).select(*keys, F.lit(None).cast("string").alias("pred"), F.lit(None).cast("double").alias("probability"))
    return done.unionByName(rest)


def forest_scores(train: DataFrame, cells: DataFrame, bands: list[str], label: str, period: str, year: str, **options) -> DataFrame:
    """year, timeframe, n, acc, macro_f1, weighted_f1: one forest a timeframe, all years' labelled cells predicted and scored."""
    from .metrics import accuracy

    out = None
    for (t,) in train.select(period).distinct().orderBy(period).collect():  # a few timeframes of a year
        model = train_forest(train.filter(F.col(period) == t), bands, label, **options)
        scored = accuracy(predict(model, cells.filter(F.col(period) == t), bands), [year, period], label, "pred")
        out = scored if out is None else out.unionByName(scored)
    return out
