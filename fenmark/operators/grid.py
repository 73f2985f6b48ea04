"""Cells of a grid: rectangles, points, neighbours and connected regions, all through equi-joins on (row, col)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = [(-1, 0), (1, 0), (0, -1), (0, 1)]
CORNER = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def rectangle_cells(boxes: DataFrame, size: float = 1.0, whole: bool = True, x0: str = "xmin", y0: str = "ymin", x1: str = "xmax", y1: str = "ymax") -> DataFrame:
    """boxes with row and col of the cells they hold wholly, or that they touch with some area."""
    up, down = (F.ceil, F.floor) if whole else (F.floor, F.ceil)
    span = lambda a, b: F.when(up(F.col(a) / size) < down(F.col(b) / size), F.sequence(up(F.col(a) / size).cast("int"), down(F.col(b) / size).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return boxes.withColumn("row", F.explode(span(y0, y1))).withColumn("col", F.explode(span(x0, x1)))


def pixelized(boxes: DataFrame, id_col: str, size: float = 1.0, whole: bool = True, **sides: str) -> DataFrame:
    """rectangle_cells with ids id_1, id_2, ... in row-major order inside each box."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(id_col).orderBy("row", "col"))
    return rectangle_cells(boxes, size, whole, **sides).withColumn("pixel_id", F.concat_ws("_", F.col(id_col).cast("string"), n.cast("string")))


def point_cells(points: DataFrame, cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """points with the columns of the cell that they fall into; points outside go."""
    return points.withColumns({"row": row.cast("int"), "col": col.cast("int")}).join(cells, ["row", "col"])


def neighbour_pairs(cells: DataFrame, keys: list[str] | None = None, corners: bool = True) -> DataFrame:
    """keys, row, col, n_row, n_col of cells that both exist and touch by an edge (or a corner)."""
    keys = keys or []
    steps = EDGE + (CORNER if corners else [])
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    own = cells.select(*keys, "row", "col").distinct()
    moved = own.withColumn("s", step).select(*keys, "row", "col", (F.col("row") + F.col("s.r")).alias("n_row"), (F.col("col") + F.col("s.c")).alias("n_col"))
    other = own.select(*keys, F.col("row").alias("n_row"), F.col("col").alias("n_col"))
    return moved.join(other, [*keys, "n_row", "n_col"], "left_semi").select(*keys, "row", "col", "n_row", "n_col")


def neighbour_counts(cells: DataFrame, keys: list[str] | None = None, corners: bool = True) -> DataFrame:
    """keys, row, col and neighbours (0 where a cell stands alone)."""
    keys = keys or []
    own = cells.select(*keys, "row", "col").distinct()
    found = neighbour_pairs(cells, keys, corners).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("c"))
    return own.join(found, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("c", F.lit(0)).alias("neighbours"))


def regions(cells: DataFrame, value: str = "value", corners: bool = True, width: int = 1 << 31) -> DataFrame:
    """cells with region: a number for each connected part of equal value (row * width + col of its first cell).

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of a region's
    extent; every second round is a checkpoint, which ends its lineage.
    """
    number = (F.col("row").cast("long") * width + F.col("col")).alias("node")
    own = cells.filter(F.col(value).isNotNull()).select("row", "col", value, number)
    ids = own.select("row", "col", "node")
    pairs = neighbour_pairs(own, [value], corners)
    edges = pairs.join(ids, ["row", "col"]).select(F.col("node").alias("a"), "n_row", "n_col").join(ids.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("node").alias("b")), ["n_row", "n_col"]).select("a", "b")
    ensure_checkpoint_dir(cells)
    edges = edges.checkpoint()
    labels = own.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.select("node", F.col("label").alias("old")).join(near, F.col("node") == F.col("a"), "left").select("node", "old", F.least("old", F.coalesce("near", "old")).alias("label"))
        far = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = step.join(far, F.col("label") == F.col("via")).select("node", "old", F.least("label", "far").alias("label")).checkpoint()
        labels = new.select("node", "label")
        if not new.filter("old <> label").head(1):
            return own.join(labels.withColumnRenamed("label", "region"), "node").drop("node")


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """The session names the folder that all executors share; only a local session gets one of its own, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(at or "/tmp/fenmark-checkpoints")
