"""Queries of sources and sinks: a table is written in a format, read back through its source, and must come home whole.

Files lie in a fresh folder below the one that the session shares for checkpoints.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import raster
from ..operators.grid import ensure_checkpoint_dir
from ..session import table
from ..sources import geotiff, gpkg, text, xlsx
from .base import query


def fresh_folder(df: DataFrame) -> str:
    """A new folder on a path that the driver and all executors can open; it goes when the driver ends."""
    ensure_checkpoint_dir(df)
    shared = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{shared.removeprefix('file:').replace('///', '/').rstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_CELLS = "SELECT CAST(o_orderkey // 100 AS INTEGER) AS row, CAST(o_orderkey % 100 AS INTEGER) AS col, max(CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_totalprice AS FLOAT) END) AS b1, max(CAST(o_custkey AS FLOAT)) AS b2 FROM orders GROUP BY 1, 2"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a raster of two bands; the first lacks some cells."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 100").cast("int").alias("row"), (k % 100).cast("int").alias("col")).agg(F.max(F.when(k % 13 > 0, F.col("o_totalprice").cast("float"))).alias("b1"), F.max(F.col("o_custkey").cast("float")).alias("b2"))


@query(f"SELECT row, col, round(CAST(b1 AS DOUBLE), 2) AS b1, round(CAST(b2 AS DOUBLE), 2) AS b2 FROM ({_CELLS})")
def geotiff_tiles(spark, sf):
    """Written as one GeoTIFF a tile by the executors, read back as blocks, and put onto one grid by the files' corners."""
    cells = _cells(spark, sf)
    folder = fresh_folder(cells)
    written = geotiff.write_tiles(cells, folder, ["b1", "b2"], (1000.0, 9000.0, 10.0), tile=64, crs=28992)
    paths = [r["path"] for r in written.select("path").collect()]  # a row for each file
    tiles = geotiff.read_geotiff(spark, f"{folder}/*.tif").filter("b1 is not null or b2 is not null")
    meta = geotiff.raster_meta(spark, paths).select("raster", "x0", "y0", "res")
    corner = meta.agg(F.min("x0").alias("gx"), F.max("y0").alias("gy"))
    home = raster.to_global(tiles, meta).join(F.broadcast(corner), F.lit(True))  # one row is joined to all
    row, col = F.col("row") + F.round((9000.0 - F.col("gy")) / 10), F.col("col") + F.round((F.col("gx") - 1000.0) / 10)
    return home.select(row.cast("int").alias("row"), col.cast("int").alias("col"), F.round("b1", 2).alias("b1"), F.round("b2", 2).alias("b2"))


@query(f"SELECT CAST(row // 64 AS INTEGER) AS i, CAST(col // 64 AS INTEGER) AS j, 'EPSG:28992' AS crs, 64 AS height, 64 AS width, 2 AS bands, CAST(1000 + 640 * (col // 64) AS DOUBLE) AS x0, CAST(9000 - 640 * (row // 64) AS DOUBLE) AS y0, CAST(10 AS DOUBLE) AS res, CAST(-9999 AS DOUBLE) AS nodata, '{{\"1\":\"bog\"}}' AS classes, 'price,customer' AS names FROM ({_CELLS}) GROUP BY ALL")
def geotiff_metadata(spark, sf):
    cells = _cells(spark, sf)
    folder = fresh_folder(cells)
    written = geotiff.write_tiles(cells, folder, ["b1", "b2"], (1000.0, 9000.0, 10.0), tile=64, crs=28992, tags={"CLASS-MAP": '{"1":"bog"}'}, descriptions=["price", "customer"])
    meta = geotiff.raster_meta(spark, [r["path"] for r in written.select("path").collect()])  # a row for each file
    place = lambda i: F.split(F.regexp_extract("raster", r"tile_(\d+_\d+)\.tif$", 1), "_")[i].cast("int")
    return meta.select(place(0).alias("i"), place(1).alias("j"), "crs", "height", "width", "bands", "x0", "y0", "res", "nodata", F.col("tags")["CLASS-MAP"].alias("classes"), F.array_join("descriptions", ",").alias("names"))


@query(f"""WITH c AS ({_CELLS}), l AS (SELECT row // 64 AS i, col // 64 AS j, 1 AS band, CAST(b1 AS DOUBLE) AS v FROM c UNION ALL SELECT row // 64, col // 64, 2, CAST(b2 AS DOUBLE) FROM c)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(band AS INTEGER) AS band, count(v) AS n, round(min(v), 2) AS min, round(max(v), 2) AS max FROM l GROUP BY i, j, band""")
def geotiff_band_stats(spark, sf):
    cells = _cells(spark, sf)
    folder = fresh_folder(cells)
    geotiff.write_tiles(cells, folder, ["b1", "b2"], (1000.0, 9000.0, 10.0), tile=64).count()
    stats = geotiff.band_stats(geotiff.read_geotiff(spark, f"{folder}/*.tif"))
    place = lambda i: F.split(F.regexp_extract("raster", r"tile_(\d+_\d+)\.tif$", 1), "_")[i].cast("int")
    return stats.select(place(0).alias("i"), place(1).alias("j"), "band", "n", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"))


def _small(spark: SparkSession, sf: str) -> tuple[DataFrame, np.ndarray]:
    """Nations by suppliers' balances as one small raster: 25 rows of 8 columns at most."""
    cells = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("row"), (F.col("s_suppkey") % 8).cast("int").alias("col")).agg(F.max(F.round("s_acctbal")).cast("int").alias("v"))
    data = np.full((1, 25, 8), -32768, np.int16)
    for r in cells.collect():
        data[0, r["row"], r["col"]] = r["v"]
    return cells, data


_SMALL = "SELECT s_nationkey AS row, CAST(s_suppkey % 8 AS INTEGER) AS col, CAST(max(round(s_acctbal)) AS DOUBLE) AS value FROM supplier GROUP BY 1, 2"


@query(f"SELECT CAST(2000 + k AS INTEGER) AS year, row, col, value + k AS value FROM ({_SMALL}), range(3) t(k)")
def zipped_geotiffs(spark, sf):
    """One GeoTIFF a year in an archive, found by the year in their names and read without unpacking."""
    cells, data = _small(spark, sf)
    folder = fresh_folder(cells)
    with zipfile.ZipFile(f"{folder}/a.zip", "w") as z:
        for k in (2, 0, 1):
            geotiff.write_geotiff(f"{folder}/x.tif", np.where(data == -32768, data, data + k).astype(np.int16), (0.0, 0.0, 1.0), -32768, block=16)
            z.write(f"{folder}/x.tif", f"inner/Map_{2000 + k}.TIF")
        z.writestr("inner/README.md", "none")
    out = None
    for year, path in geotiff.yearly_members(f"{folder}/a.zip"):
        one = geotiff.read_geotiff(spark, path).filter("b1 is not null").select(F.lit(year).alias("year"), "row", "col", F.col("b1").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT row, col, value AS b02, value AS b03 FROM ({_SMALL})")
def zipped_bands(spark, sf):
    """Bands found in an archive by file name, whatever its case and folder, and stacked."""
    cells, data = _small(spark, sf)
    folder = fresh_folder(cells)
    geotiff.write_geotiff(f"{folder}/x.tif", data, (0.0, 0.0, 1.0), -32768, block=16)
    with zipfile.ZipFile(f"{folder}/a.zip", "w") as z:
        for name in ("deep/er/b02.TIF", "B03.tif", "other.tif"):
            z.write(f"{folder}/x.tif", name)
    long = None
    for band, path in geotiff.zip_members(f"{folder}/a.zip", ["B02.tif", "B03.tif"]).items():
        one = geotiff.read_geotiff(spark, path).filter("b1 is not null").select("row", "col", F.lit(band[:3].lower()).alias("band"), F.col("b1").alias("value"))
        long = one if long is None else long.unionByName(one)
    return raster.stack(long, ["b02", "b03"])


@query("SELECT p_partkey AS n, p_brand AS brand, p_retailprice AS price, CAST((p_size + 1) * 2 AS DOUBLE) AS area FROM part")
def gpkg_layer(spark, sf):
    """A layer written, listed, and read in ranges of rows, without a column that nobody wants; unknown ones don't matter."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("unwanted"), G.st_box(F.col("p_partkey"), F.lit(0.0), F.col("p_partkey") + F.col("p_size") + 1, F.lit(2.0)).alias("geometry"))
    path = f"{fresh_folder(p)}/a.gpkg"
    gpkg.write_gpkg(rows, path, "parts", 28992)
    (layer,) = gpkg.layers(path)
    got = gpkg.read_gpkg(spark, path, layer, ["n", "brand", "price", "absent"])
    return got.select("n", "brand", "price", F.round(G.st_area(F.col("geometry")), 6).alias("area"))


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS note FROM nation")
def xlsx_sheet(spark, sf):
    nation = table(spark, sf, "nation")
    path = f"{fresh_folder(nation)}/a.xlsx"
    rows = [("name", "key", "note", "unwanted"), *[(r["n_name"], str(r["n_nationkey"]), None, "x") for r in nation.collect()]]  # a lookup table
    xlsx.write_xlsx(path, rows)
    return xlsx.read_xlsx(spark, path, columns=["name", "key", "note", "absent"])


_DAYS = "SELECT l_suppkey % 4 AS station, CAST(l_shipdate AS DATE) AS date, count(*) AS n, min(l_linenumber) AS m FROM lineitem GROUP BY 1, 2"


@query(f"SELECT CAST(station AS INTEGER) AS station, date, n / 10.0 AS temp_c, CASE WHEN m = 1 THEN 0.05 ELSE m / 10.0 END AS precip_mm, CASE WHEN m < 3 THEN m / 10.0 END AS pet_mm FROM ({_DAYS})", dates=("date",))
def station_files(spark, sf):
    """A station's days as text below a commented header: tenths, blanks, and -1 for a trace of rain."""
    days = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("station"), F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("m"))
    line = F.concat_ws(",", F.format_string("%5d", "station"), F.date_format("date", "yyyyMMdd"), F.format_string("%5d", "n"), F.when(F.col("m") == 1, "   -1").otherwise(F.format_string("%5d", "m")), F.when(F.col("m") < 3, F.format_string("%5d", "m")).otherwise("     "))
    path = f"{fresh_folder(days)}/days"
    header = spark.createDataFrame([("# comment, 12",), ("STN,YYYYMMDD,   TG,   RH, EV24",), ("",)], "value string")
    header.union(days.select(line.alias("value"))).write.text(path)
    return text.trace_precipitation(text.read_station_days(spark, path, ["temp_c", "precip_mm", "pet_mm"]))


@query("SELECT n_nationkey AS value, n_name || ': ' || n_regionkey AS class FROM nation")
def zipped_class_list(spark, sf):
    """The class list in an archive's README; names may hold colons, and other lines don't matter."""
    nation = table(spark, sf, "nation")
    path = f"{fresh_folder(nation)}/a.zip"
    items = "".join(f" - {r['n_nationkey']} :  {r['n_name']}: {r['n_regionkey']} \n" for r in nation.collect())  # a lookup table
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("inner/ReadMe.md", f"# Classes\n- no number: x\n-7\n{items}\nplain 3: y\n")
    return text.class_list(text.read_zip_text(spark, path, "README.md"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def csv_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = f"{fresh_folder(orders)}/t"
    orders.write.option("header", True).csv(path)
    return text.read_table(spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, 'Q' || quarter(o_orderdate) AS timeframe FROM orders WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) = 2")
def period_folders(spark, sf):
    """Parquet by year and quarter; a reader of one quarter opens its folder alone."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("timeframe"))
    path = f"{fresh_folder(orders)}/p"
    text.write_periods(orders, path)
    got = spark.read.option("basePath", path).parquet(text.period_path(path, 1996, "Q2"))
    return got.select("o_orderkey", F.col("year").cast("int").alias("year"), "timeframe")
