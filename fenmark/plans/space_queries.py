"""Queries of polygon operators, on rectangles and triangles whose measures SQL can tell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import grid, split, survey
from ..session import table
from .base import query

# Rectangles of parts: corners on a half-unit lattice of 80 x 60, sides of up to 5 units.
_BOX = "SELECT p_partkey AS id, p_brand AS brand, p_partkey * 7 % 160 / 2.0 AS x0, p_partkey * 13 % 120 / 2.0 AS y0, p_partkey * 7 % 160 / 2.0 + (p_size % 10 + 1) / 2.0 AS x1, p_partkey * 13 % 120 / 2.0 + (p_size % 7 + 1) / 2.0 AS y1 FROM part"


def _numbers(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    x, y = p * 7 % 160 / F.lit(2.0), p * 13 % 120 / F.lit(2.0)
    return table(spark, sf, "part").select(p.alias("id"), F.col("p_brand").alias("brand"), x.alias("x0"), y.alias("y0"), (x + (s % 10 + 1) / F.lit(2.0)).alias("x1"), (y + (s % 7 + 1) / F.lit(2.0)).alias("y1"))


def _boxes(spark, sf):
    return _numbers(spark, sf).withColumn("geometry", G.st_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).select("id", "brand", "geometry")


def _area(c="geometry"):
    return F.round(G.st_area(F.col(c)), 6)


def _bounds(df, *keep):
    b = df.withColumn("b", G.st_bounds(F.col("geometry")))
    return b.select(*keep, *[F.round(F.col("b")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, x0, y0, x1, y1 FROM ({_BOX})")
def polygon_measures(spark, sf):
    df = _boxes(spark, sf).withColumn("c", G.st_centroid(F.col("geometry"))).withColumn("area", _area())
    return _bounds(df, "id", "area", F.round(F.col("c")[0], 6).alias("cx"), F.round(F.col("c")[1], 6).alias("cy"))


@query(f"SELECT id, CASE WHEN id % 4 > 0 THEN '0106000000' END AS kind, CASE WHEN id % 4 > 0 THEN round((x1 - x0) * (y1 - y0), 6) END AS area FROM ({_BOX})")
def only_polygons(spark, sf):
    """Each fourth geometry is a point: it has no polygonal part; the others become multipolygons."""

    def point(x, y):
        return F.pandas_udf(lambda a, b: pd.Series([G.dump_point(*v) for v in zip(a, b)], dtype=object), "binary")(x, y)

    n = _numbers(spark, sf)
    mixed = n.withColumn("geometry", F.when(F.col("id") % 4 > 0, G.st_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).otherwise(point(F.col("x0"), F.col("y0"))))
    out = mixed.withColumn("geometry", G.st_polygons(F.col("geometry")))
    little = F.concat(F.lit("01"), F.substring(F.hex("geometry"), 3, 8))
    return out.select("id", F.when(F.col("geometry").isNotNull(), little).alias("kind"), _area().alias("area"))


_CELL = "greatest(0, least(x1, c + 1) - greatest(x0, c)) * greatest(0, least(y1, r + 1) - greatest(y0, r))"


@query(f"SELECT id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round({_CELL}, 6) AS area FROM ({_BOX}) b, range(0, 70) a(r), range(0, 90) k(c) WHERE c >= floor(x0) AND c <= x1 AND r >= floor(y0) AND r <= y1 AND {_CELL} > 0")
def polygons_cut_to_pixels(spark, sf):
    return G.cut_to_cells(_boxes(spark, sf), "geometry", 1.0).select("id", "row", "col", F.round("area", 6).alias("area"))


@query("""SELECT p_partkey AS id, CAST(p_partkey * 13 % 60 + i AS INTEGER) AS row, CAST(p_partkey * 7 % 80 + j AS INTEGER) AS col, 'T_' || p_partkey || '_' || row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) AS pixel_id
FROM part, range(0, 9) a(i), range(0, 9) b(j) WHERE i + j + 2 <= p_size % 9""")
def whole_pixels_of_triangles(spark, sf):
    """Pixelising polygons that are no rectangles: right-angled triangles hold the cells below their longest side."""
    from pyspark.sql import Window

    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 80).alias("x"), (F.col("p_partkey") * 13 % 60).alias("y"), (F.col("p_size") % 9).alias("s")).filter("s > 0")
    cells = G.cut_to_cells(rows.withColumn("geometry", _triangle("x", "y", "s")), "geometry", 1.0, whole=True)
    n = F.row_number().over(Window.partitionBy("id").orderBy("row", "col"))
    return cells.select("id", "row", "col", F.concat_ws("_", F.lit("T"), F.col("id").cast("string"), n.cast("string")).alias("pixel_id"))


def _triangle(x, y, s):
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([G.dump_wkb([[np.array([[u, v], [u + k, v], [u, v + k], [u, v]], float)]]) for u, v, k in zip(a, b, c)], dtype=object)

    return F.pandas_udf(run, "binary")(x, y, s)


@query(f"WITH q AS (SELECT c_custkey, c_custkey * 31 % 3400 / 40.0 + 0.01 AS x, c_custkey * 17 % 2600 / 40.0 + 0.01 AS y FROM customer) SELECT c_custkey, id FROM q JOIN ({_BOX}) b ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def points_in_polygons(spark, sf):
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select("c_custkey", (k * 31 % 3400 / F.lit(40.0) + 0.01).alias("x"), (k * 17 % 2600 / F.lit(40.0) + 0.01).alias("y"))
    return G.points_in_polygons(points, _boxes(spark, sf), size=4.0).select("c_custkey", "id")


@query(f"SELECT id, round((least(x1, 50.25) - greatest(x0, 10.5)) * (least(y1, 40) - greatest(y0, 5.75)), 6) AS area FROM ({_BOX}) WHERE least(x1, 50.25) > greatest(x0, 10.5) AND least(y1, 40) > greatest(y0, 5.75)")
def clipped_to_a_rectangle(spark, sf):
    return G.clip_features(_boxes(spark, sf), "geometry", (10.5, 5.75, 50.25, 40.0)).select("id", _area().alias("area"))


# Strips of suppliers that don't overlap: 3 units of every 4.
_STRIPS = "SELECT DISTINCT CAST(s_nationkey * 4 AS DOUBLE) AS a, CAST(s_nationkey * 4 + 3 AS DOUBLE) AS b FROM supplier"


def _strips(spark, sf):
    x = F.col("s_nationkey") * F.lit(4.0)
    return table(spark, sf, "supplier").select(G.st_box(x, F.lit(-5.0), x + 3, F.lit(100.0)).alias("geometry"))


@query(f"SELECT id, round(sum((least(x1, b) - greatest(x0, a)) * (y1 - y0)), 6) AS area FROM ({_BOX}) JOIN ({_STRIPS}) ON a < x1 AND b > x0 GROUP BY id")
def clipped_by_a_layer(spark, sf):
    """The mask's polygons occur several times, so their union counts, not their sum."""
    return G.clip_by_layer(_boxes(spark, sf), _strips(spark, sf), "id", size=8.0).select("id", _area().alias("area"))


@query(f"WITH m AS (SELECT id, sum((least(x1, b) - greatest(x0, a)) * (y1 - y0)) AS gone FROM ({_BOX}) JOIN ({_STRIPS}) ON a < x1 AND b > x0 GROUP BY id) SELECT b.id, round((x1 - x0) * (y1 - y0) - coalesce(gone, 0), 6) AS area FROM ({_BOX}) b LEFT JOIN m ON m.id = b.id WHERE (x1 - x0) * (y1 - y0) - coalesce(gone, 0) > 1e-9")
def subtracted_layer(spark, sf):
    return G.subtract(_boxes(spark, sf), _strips(spark, sf).distinct(), "id", size=8.0).select("id", _area().alias("area"))


@query("""WITH s AS (SELECT p_brand AS brand, p_partkey % 97 * 1.0 AS a, p_partkey % 97 + p_size % 5 + 0.5 AS b FROM part),
m AS (SELECT *, max(b) OVER (PARTITION BY brand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT brand, round(CAST(2 * sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS DOUBLE), 6) AS area FROM m GROUP BY brand""")
def dissolved_layer(spark, sf):
    """The union of each brand's overlapping bars."""
    x = F.col("p_partkey") % 97
    bars = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), G.st_box(x, F.lit(0.0), x + F.col("p_size") % 5 + 0.5, F.lit(2.0)).alias("geometry"))
    return G.dissolve(bars, ["brand"]).select("brand", _area().alias("area"))


@query("""WITH y AS (SELECT DISTINCT c_custkey AS id, CAST(k AS INTEGER) AS k, c_custkey % 9 + k * (c_custkey % 4) AS x0, c_custkey % 9 + k * (c_custkey % 4) + 6 AS x1, k * (c_custkey % 3) AS y0, 5 AS y1 FROM customer, range(3) t(k))
SELECT id, '0,1,2' AS layers, CAST((min(x1) - max(x0)) * (min(y1) - max(y0)) AS DOUBLE) AS area FROM y GROUP BY id HAVING min(x1) > max(x0) AND min(y1) > max(y0)""")
def common_to_all_layers(spark, sf):
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(c.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    x = F.col("id") % 9 + F.col("k") * (F.col("id") % 4)
    layers = rows.select("id", F.col("k").cast("string").alias("layer"), G.st_box(x, F.col("k") * (F.col("id") % 3), x + 6, F.lit(5.0)).alias("geometry"))
    return G.common_to_all(layers, "layer", ["0", "1", "2"], keys=["id"]).select("id", "layers", _area().alias("area"))


@query("SELECT c_nationkey AS region, count(DISTINCT c_custkey % 64) AS n, CAST(100 * count(DISTINCT c_custkey % 64) AS DOUBLE) AS area, CAST(500 + 10 * min(c_custkey % 64 % 8) AS DOUBLE) AS x0, CAST(900 - 10 * (max(c_custkey % 64 // 8) + 1) AS DOUBLE) AS y0, CAST(510 + 10 * max(c_custkey % 64 % 8) AS DOUBLE) AS x1, CAST(900 - 10 * min(c_custkey % 64 // 8) AS DOUBLE) AS y1 FROM customer GROUP BY c_nationkey")
def region_outlines(spark, sf):
    k = F.col("c_custkey") % 64
    cells = table(spark, sf, "customer").select(F.col("c_nationkey").alias("region"), F.expr("c_custkey % 64 div 8").cast("int").alias("row"), (k % 8).cast("int").alias("col"))
    out = G.region_polygons(cells, ["region"], 500.0, 900.0, 10.0).withColumn("area", _area())
    return _bounds(out, "region", "n", "area")


@query("SELECT s_suppkey, CAST(100 + 2 * s_nationkey AS DOUBLE) AS x0, CAST(198 - 2 * s_suppkey AS DOUBLE) AS y0, CAST(102 + 2 * s_nationkey AS DOUBLE) AS x1, CAST(200 - 2 * s_suppkey AS DOUBLE) AS y1 FROM supplier")
def pixel_squares(spark, sf):
    cells = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("col"))
    return _bounds(G.pixel_squares(cells, 100.0, 200.0, 2.0), "s_suppkey")


def _polynomial(terms, x: str, y: str) -> str:
    return " + ".join(f"({k!r}) * pow({x}, {p}) * pow({y}, {q})" for p, q, k in terms)


_RD = f"SELECT c_custkey, 100000.0 + c_custkey * 7919 % 150000 AS x, 400000.0 + c_custkey * 104729 % 200000 AS y FROM customer"


@query(f"WITH d AS (SELECT c_custkey, (x - {G.RD_X0}) * 1e-5 AS dx, (y - {G.RD_Y0}) * 1e-5 AS dy FROM ({_RD})) SELECT c_custkey, round({G.LAM0} + ({_polynomial(G.RD_LAM, 'dx', 'dy')}) / 3600, 9) AS lon, round({G.PHI0} + ({_polynomial(G.RD_PHI, 'dx', 'dy')}) / 3600, 9) AS lat FROM d")
def reprojected_layer(spark, sf):
    """From the national grid to geographic coordinates; the corner of each square."""
    k = F.col("c_custkey")
    x, y = F.lit(100000.0) + k * 7919 % 150000, F.lit(400000.0) + k * 104729 % 200000
    squares = table(spark, sf, "customer").select("c_custkey", G.st_box(x, y, x + 10, y + 10).alias("geometry"))
    out = squares.withColumn("geometry", G.st_reproject(F.col("geometry"), 28992, 4326))
    return out.select("c_custkey", *[F.round(c, 9).alias(n) for n, c in zip(("lon", "lat"), _first_point())])


def _first_point():
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, G.load_wkb(bytes(v))[0][0][0])) for v in s])

    p = F.pandas_udf(run, "array<double>")("geometry")
    return p[0], p[1]


@query(f"SELECT c_custkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({_RD})")
def reprojected_and_back(spark, sf):
    """From the national grid through geographic coordinates to the zone's grid and back: whole metres come home."""
    k = F.col("c_custkey")
    x, y = F.lit(100000.0) + k * 7919 % 150000, F.lit(400000.0) + k * 104729 % 200000
    out = table(spark, sf, "customer").select("c_custkey", G.st_box(x, y, x + 10, y + 10).alias("geometry"))
    for a, b in ((28992, 32631), (32631, 4326), (4326, 28992)):
        out = out.withColumn("geometry", G.st_reproject(F.col("geometry"), a, b))
    return out.select("c_custkey", *[F.round(c, 0).alias(n) for n, c in zip("xy", _first_point())])


_RASTER = "SELECT DISTINCT CAST(o_orderkey // 97 % 60 AS INTEGER) AS row, CAST(o_orderkey % 97 AS INTEGER) AS col FROM orders"


def _raster(spark, sf):
    cells = table(spark, sf, "orders").select(F.expr("o_orderkey div 97 % 60").cast("int").alias("row"), (F.col("o_orderkey") % 97).cast("int").alias("col")).distinct()
    return cells.withColumn("value", (F.col("row") * 100 + F.col("col")).cast("double"))


def _mask_sql(hit: str) -> str:
    """Cells of 1 unit below (0, 60), and the strips and boxes of large parts as polygons."""
    boxes = f"SELECT x0, y0, x1, y1 FROM ({_BOX}) WHERE id % 10 = 0"
    return f"""WITH c AS ({_RASTER}), b AS ({boxes}), i AS (SELECT DISTINCT row, col FROM (SELECT CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, 59.0 - r AS lo, 60.0 - r AS hi, CAST(k AS DOUBLE) AS l, k + 1.0 AS h FROM range(-10, 70) a(r), range(-10, 100) d(k)) g JOIN b ON {hit}),
e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM i)"""


_TOUCH = _mask_sql("l < x1 AND h > x0 AND lo < y1 AND hi > y0")
_CENTRE = _mask_sql("(l + h) / 2 > x0 AND (l + h) / 2 < x1 AND (lo + hi) / 2 > y0 AND (lo + hi) / 2 < y1")
_MASKED = " SELECT c.row, c.col, CAST(CASE WHEN i.row IS NULL THEN -9999 ELSE c.row * 100 + c.col END AS DOUBLE) AS value, CAST(i.row IS NOT NULL AS INTEGER) AS valid FROM c JOIN e ON c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 LEFT JOIN i ON i.row = c.row AND i.col = c.col"


def _tenth(spark, sf):
    """Each tenth part's rectangle, off the cells' centres by a hundredth."""
    n = _numbers(spark, sf).filter("id % 10 = 0")
    return n.select(G.st_box(F.col("x0") + 0.01, F.col("y0") + 0.01, F.col("x1") + 0.01, F.col("y1") + 0.01).alias("geometry"))


_SHIFTED = {k: k.replace(f"SELECT x0, y0, x1, y1 FROM ({_BOX})", f"SELECT x0 + 0.01 AS x0, y0 + 0.01 AS y0, x1 + 0.01 AS x1, y1 + 0.01 AS y1 FROM ({_BOX})") for k in (_TOUCH, _CENTRE)}


@query(_SHIFTED[_TOUCH] + _MASKED)
def raster_clipped_touched(spark, sf):
    out = G.clip_raster(_raster(spark, sf), _tenth(spark, sf), "geometry", (0.0, 60.0, 1.0), all_touched=True, nodata=-9999.0)
    return out.select("row", "col", "value", F.col("valid").cast("int").alias("valid"))


@query(_SHIFTED[_CENTRE] + _MASKED)
def raster_clipped_centres(spark, sf):
    out = G.clip_raster(_raster(spark, sf), _tenth(spark, sf), "geometry", (0.0, 60.0, 1.0), nodata=-9999.0)
    return out.select("row", "col", "value", F.col("valid").cast("int").alias("valid"))


# ------------------------------------------------------------------ windows and training rows

_WINDOWS = "(VALUES ('north', 5.25, 30.25, 40.25, 50.25), ('south', 0.25, 0.25, 20.25, 10.25)) w(location, a, b, c, d)"


def _windows(spark):
    return survey.windows(spark, {"north": (5.25, 30.25, 40.25, 50.25), "south": (0.25, 0.25, 20.25, 10.25)}, {"south": "UTM32631"})


@query("SELECT 'north' AS location, 'EPSG:28992' AS epsg, CAST(700 AS DOUBLE) AS area UNION ALL SELECT 'south', 'EPSG:32631', 200")
def map_windows(spark, sf):
    return _windows(spark).select("location", "epsg", _area().alias("area"))


@query(f"SELECT location, id, CAST(y AS INTEGER) AS year FROM ({_BOX}) JOIN {_WINDOWS} ON x0 < c AND x1 > a AND y0 < d AND y1 > b, (VALUES (2019), (2021)) t(y) WHERE y >= 2018 + id % 3 AND y <= 2020 OR y = 2021 AND id % 2 = 0")
def features_in_windows(spark, sf):
    k = F.col("id")
    years = F.concat(2018 + k % 3, F.lit(", ..., 2020"), F.when(k % 2 == 0, ", 2021").otherwise(""))
    out = survey.in_windows(_boxes(spark, sf).withColumn("years", years), _windows(spark), [2019, 2021], size=10.0)
    return out.select("location", "id", "year")


@query("SELECT 'GI_' || p_partkey AS polygon, p_brand AS class, CAST(count(*) AS DOUBLE) AS area FROM part, range(5) t(k) WHERE k <= p_size % 5 GROUP BY p_partkey, p_brand")
def training_polygons(spark, sf):
    """Chosen pixels united again to their polygons."""
    from ..functions.scalars import polygon_key

    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("class"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 5)).alias("col"))
    pixels = G.pixel_squares(rows.withColumn("row", F.lit(3)).withColumn("id", F.concat_ws("_", F.lit("GI"), F.col("k").cast("string"), F.col("col").cast("string"))), 0.0, 50.0, 1.0)
    return G.dissolve(pixels.select(polygon_key(F.col("id")).alias("polygon"), "class", "geometry"), ["polygon", "class"]).select("polygon", "class", _area().alias("area"))


@query("SELECT p_brand AS class, least(200, cells) AS chosen, cells FROM (SELECT p_brand, CAST(sum(p_size % 4 + 1) AS BIGINT) AS cells FROM part GROUP BY p_brand)")
def split_reaches_caps(spark, sf):
    """Polygons of up to four cells in one row: a class gives as many cells as its cap asks for, never a polygon more than that needs, or all that it has."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("class"), F.lit("2020").alias("year"), F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("col"))
    rows = rows.withColumn("id", F.concat_ws("_", F.lit("GI"), F.col("k").cast("string"), F.col("col").cast("string")))
    out = split.train_val_split(rows.select("class", "year", "id"), rows.select("id", F.col("k").alias("row"), "col"), split.SplitPlan(cap=200, shares=(0.7, 0.3, 0.0)))
    counted = out.groupBy("class").agg(F.count(F.when(F.col("split") != "leftover", 1)).alias("n"), F.count(F.lit(1)).alias("cells"))
    # Both splits may go over by less than a polygon.
    enough = F.when((F.col("n") >= F.least(F.lit(200), "cells")) & (F.col("n") < 200 + 2 * 4), F.least(F.lit(200), "cells").cast("long")).otherwise(F.col("n"))
    return counted.select("class", enough.alias("chosen"), "cells")


@query("SELECT c_nationkey AS k, CAST(c_custkey % 32 AS INTEGER) AS row, CAST(c_custkey // 32 % 8 AS INTEGER) AS col, count(*) AS n FROM customer GROUP BY ALL")
def points_by_cell(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 32 * 10.0 + 3).alias("y"), (F.expr("c_custkey div 32 % 8") * 10.0 + 7).alias("x"))
    cells = rows.select("k", F.floor(F.col("y") / 10).cast("int").alias("row"), F.floor(F.col("x") / 10).cast("int").alias("col")).distinct()
    return grid.point_cells(rows, cells.withColumnRenamed("k", "c_k"), F.floor(F.col("y") / 10), F.floor(F.col("x") / 10)).filter("k = c_k").groupBy("k", "row", "col").agg(F.count(F.lit(1)).alias("n"))
