"""Queries of map preparation, validation, rasters by cell and station series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import metrics, raster, split, survey, timeseries
from ..session import table
from .base import query

# ------------------------------------------------------------------ tags, legends and bands

_BRANDS = "SELECT DISTINCT p_size AS value, 'class ' || p_size AS class FROM part"


def _tagged(spark, sf, tag):
    """A raster for each brand, whose tag holds its sizes' classes."""
    pairs = table(spark, sf, "part").select(F.col("p_brand").alias("raster"), "p_size").distinct()
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("p_size").cast("string").alias("k"), F.concat(F.lit("class "), "p_size").alias("v"))))))
    return pairs.groupBy("raster").agg(F.create_map(F.lit(tag), text, F.lit("OTHER"), F.lit("x")).alias("tags"))


@query("SELECT DISTINCT p_brand AS raster, p_size AS value, 'class ' || p_size AS class FROM part")
def class_map_tags(spark, sf):
    return survey.class_map(_tagged(spark, sf, "CLASS_MAP"))


@query("SELECT r.raster, v.value, CASE WHEN r.raster LIKE '%1' THEN 'class ' || v.value ELSE 'new ' || v.value END AS class FROM (SELECT DISTINCT p_brand AS raster FROM part) r, (SELECT DISTINCT p_brand AS raster, p_size AS value FROM part) v WHERE v.raster = r.raster AND r.raster LIKE '%1' UNION ALL SELECT r.raster, v, 'new ' || v FROM (SELECT DISTINCT p_brand AS raster FROM part) r, (VALUES (1), (2)) t(v) WHERE r.raster NOT LIKE '%1'")
def class_map_added(spark, sf):
    """Rasters without a class map get one; others keep theirs."""
    tagged = _tagged(spark, sf, "CLASS-MAP")
    some = tagged.withColumn("tags", F.when(F.col("raster").like("%1"), F.col("tags")).otherwise(F.create_map(F.lit("OTHER"), F.lit("x"))))
    return survey.class_map(survey.with_class_map(some, {1: "new 1", 2: "new 2"}))


@query("SELECT DISTINCT p_brand AS raster, CAST(p_size AS VARCHAR) AS class, 'class ' || p_size AS color FROM part")
def legend_tags(spark, sf):
    return survey.legend(_tagged(spark, sf, "LEGEND"))


_BANDS = "SELECT s_nationkey AS raster, s_suppkey AS band, CASE WHEN s_suppkey % 5 = 0 THEN 'mask' ELSE 'Class_' || 2017 + s_suppkey % 4 || '_x' END AS description FROM supplier"


def _bands(spark, sf):
    text = F.when(F.col("s_suppkey") % 5 == 0, "mask").otherwise(F.concat(F.lit("Class_"), 2017 + F.col("s_suppkey") % 4, F.lit("_x")))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("raster"), F.col("s_suppkey").alias("band"), text.alias("description"))


@query(f"SELECT raster, CAST(regexp_extract(description, '20[0-9][0-9]') AS INTEGER) AS year, string_agg(CAST(band AS VARCHAR), ',' ORDER BY band) AS bands FROM ({_BANDS}) WHERE description <> 'mask' GROUP BY 1, 2")
def band_years(spark, sf):
    return survey.band_years(_bands(spark, sf)).withColumn("bands", F.array_join("bands", ","))


@query(f"SELECT raster, CAST(regexp_extract(description, '20[0-9][0-9]') AS INTEGER) AS year, CAST(count(*) AS INTEGER) AS n FROM ({_BANDS}) WHERE description <> 'mask' GROUP BY 1, 2 HAVING count(*) <> 1")
def band_mapping_faults(spark, sf):
    return survey.mapping_faults(survey.band_years(_bands(spark, sf)), 1)


@query(f"SELECT raster, min(band) AS band FROM ({_BANDS}) WHERE description LIKE 'Class_2018%' GROUP BY raster")
def band_by_description(spark, sf):
    return raster.band_by_description(_bands(spark, sf), "CLASS_2018")


# ------------------------------------------------------------------ rows for maps


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE quarter(l_shipdate) = 3")
def rows_of_a_timeframe(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("timeframe", F.concat(F.lit("Q"), F.quarter("l_shipdate")))
    return survey.of_timeframe(rows, "Q3").select("l_orderkey", "l_linenumber")


@query("SELECT n_name AS type, n_regionkey AS color FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey IN (2, 5))")
def without_types(spark, sf):
    nation = table(spark, sf, "nation")
    names = [r[0] for r in nation.filter("n_nationkey in (2, 5)").select("n_name").collect()]  # two rows
    return survey.without_types(nation.select(F.col("n_name").alias("type"), F.col("n_regionkey").alias("color")), names)


@query("""SELECT o_orderkey, r_name AS division, CAST(y AS VARCHAR) AS year FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey, range(2018, 2024) t(y)
WHERE n_regionkey <> 2 AND (y <= 2018 + o_orderkey % 3 OR y = 2023)""")
def rows_of_maps(spark, sf):
    """Rows with their division, which those of one region lack, and a row for each year of texts with dots."""
    years = F.concat(F.lit("2018, ..., "), (2018 + F.col("o_orderkey") % 3).cast("string"), F.lit(", 2023"))
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("code"), years.alias("years"))
    reference = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("code"), F.when(F.col("n_regionkey") != 2, F.col("r_name")).alias("division"))
    return survey.map_rows(rows, reference, "code", "division").select("o_orderkey", "division", "year")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE year(o_orderdate) = 1996", dates=("day",))
def rows_of_a_year(spark, sf):
    rows = table(spark, sf, "orders").withColumn("years", F.concat_ws(", ", F.lit("11996"), F.year("o_orderdate").cast("string")))
    return survey.of_year(rows, 1996).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT s_suppkey, y AS year FROM supplier, (VALUES (2017), (2020), (2024)) t(y)")
def features_of_years(spark, sf):
    return survey.features_of_years(table(spark, sf, "supplier"), [2017, 2020, 2024]).select("s_suppkey", "year")


@query("SELECT s_suppkey, CASE WHEN n_regionkey < 4 THEN 'c' || n_regionkey ELSE '#000000' END AS color, CAST(CASE WHEN n_regionkey = 4 THEN 0 WHEN n_regionkey = 1 THEN 0.5 ELSE 1 END AS DOUBLE) AS alpha FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def coloured_cells(spark, sf):
    cells = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    colours = table(spark, sf, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("value"), F.concat(F.lit("c"), "r_regionkey").alias("color"))
    return survey.coloured(cells, colours, "n_regionkey", alpha={1: 0.5}).select("s_suppkey", "color", "alpha")


@query("SELECT s_suppkey, CASE WHEN n_regionkey IN (0, 1) THEN 'c' || n_regionkey ELSE '#000000' END AS color, CAST(CASE WHEN n_regionkey IN (0, 1) THEN 0.7 ELSE 0 END AS DOUBLE) AS alpha FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def class_background(spark, sf):
    """Through names: one region has no class, two classes have no colour."""
    cells = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "value")
    classes = table(spark, sf, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("value"), F.col("r_name").alias("class"))
    colours = table(spark, sf, "region").filter("r_regionkey < 2").select(F.col("r_name").alias("type"), F.concat(F.lit("c"), "r_regionkey").alias("color"))
    return survey.background(cells, "CLASS-MAP", classes, colours, alpha=0.7).select("s_suppkey", "color", "alpha")


@query("SELECT p_partkey, round(p_size / 255.0, 9) AS r, round(greatest(p_partkey % 300 - 20, 0) / 255.0, 9) AS g, CAST(1 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS alpha FROM part WHERE p_partkey % 300 - 20 <= 255 UNION ALL SELECT p_partkey, round(p_size / 255.0, 9), 1, 1, 1 FROM part WHERE p_partkey % 300 - 20 > 255")
def rgb_background(spark, sf):
    cells = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("r"), (F.col("p_partkey") % 300 - 20).cast("double").alias("g"), F.lit(300.0).alias("b"))
    return survey.background(cells, "rgb").select("p_partkey", F.round("r", 9).alias("r"), F.round("g", 9).alias("g"), "b", "alpha")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 4 IN (1, 2) THEN 0.8 ELSE 0 END AS DOUBLE) AS alpha FROM part")
def shown_colours(spark, sf):
    """Black is hidden, one listed colour is left out, and so are colours that the legend lacks."""
    k = F.col("p_size") % 4
    cells = table(spark, sf, "part").select("p_partkey", F.when(k == 0, 0).otherwise(k * 10).alias("r"), F.when(k == 0, 0).otherwise(5).alias("g"), F.when(k == 0, 0).otherwise(7).alias("b"))
    legend = {"one": (10, 5, 7), "two": (20, 5, 7), "three": (30, 5, 7), "black": (0, 0, 0)}
    return survey.shown_colours(cells, legend, exclude=["three"], alpha=0.8).select("p_partkey", "alpha")


# ------------------------------------------------------------------ rasters by cell


@query("""WITH m AS (SELECT user_id, year(ts) AS year, quarter(ts) AS quarter, CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (event_type = 'click') AS DOUBLE) AS vv, CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (event_type = 'view') AS DOUBLE) AS vh FROM events GROUP BY 1, 2, 3)
SELECT user_id, year, quarter, CASE WHEN vv > 0 THEN round(10 * log10(greatest(vv, 1e-10)), 9) END AS vv_db, CASE WHEN vh > 0 THEN round(10 * log10(greatest(vh, 1e-10)), 9) END AS vh_db,
  CASE WHEN abs(vh) > 1e-10 AND vv / vh > 0 THEN round(10 * log10(greatest(vv / vh, 1e-10)), 9) END AS ratio_db FROM m""")
def quarterly_db(spark, sf):
    e = table(spark, sf, "events")
    total = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value").cast("decimal(18,2)"))).cast("double")
    sums = e.groupBy("user_id", F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(total("click").alias("vv"), total("view").alias("vh"))
    out = raster.db_of_means(sums)
    return out.select("user_id", "year", "quarter", *[F.round(c, 9).alias(c) for c in ("vv_db", "vh_db", "ratio_db")])


@query("SELECT o_custkey % 5 AS raster, CAST(o_orderkey // 100 + 7 * (o_custkey % 5) AS BIGINT) AS row, CAST(o_orderkey % 100 + 11 * (o_custkey % 5) AS BIGINT) AS col FROM orders")
def tiles_on_one_grid(spark, sf):
    """Five tiles, shifted against each other by whole cells of 10 units."""
    tiles = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("raster"), F.expr("o_orderkey div 100").alias("row"), (F.col("o_orderkey") % 100).alias("col"))
    meta = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("raster"), (F.lit(500.0) + 110 * F.col("r_regionkey")).alias("x0"), (F.lit(9000.0) - 70 * F.col("r_regionkey")).alias("y0"), F.lit(10.0).alias("res"))
    return raster.to_global(tiles, meta).select("raster", "row", "col")


@query("SELECT l_orderkey, l_linenumber, 'tile_' || b AS band, CASE b WHEN 'tax' THEN l_tax ELSE l_discount END AS value FROM lineitem, (VALUES ('tax'), ('discount')) t(b)")
def unstacked_bands(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return raster.unstack(wide, ["tax", "discount"], ["l_orderkey", "l_linenumber"], "tile")


@query("SELECT l_orderkey, l_linenumber, CAST(l_tax > 0 AND l_discount > 0.02 AS INTEGER) AS valid FROM lineitem")
def valid_mask(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"))
    return raster.valid_stack(wide, ["a", "b"]).select("l_orderkey", "l_linenumber", F.col("VALID_MASK").cast("int").alias("valid"))


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 3 THEN NULL WHEN n_nationkey % 7 = 4 THEN 'EPSG:4326' ELSE 'EPSG:28992' END AS crs, n_nationkey % 5 * 0.4 AS off FROM nation)
SELECT CAST(k AS VARCHAR) AS raster, coalesce(crs = 'EPSG:28992' AND off <= 0.5, FALSE) AS same FROM n""")
def compared_grids(spark, sf):
    k = F.col("n_nationkey")
    crs = F.when(k % 7 == 3, F.lit(None)).when(k % 7 == 4, "EPSG:4326").otherwise("EPSG:28992")
    meta = table(spark, sf, "nation").select(k.cast("string").alias("raster"), crs.cast("string").alias("crs"), F.lit(100).alias("height"), F.lit(200).alias("width"), (F.lit(1000.0) + k % 5 * 0.4).alias("x0"), F.lit(5000.0).alias("y0"), F.lit(10.0).alias("res"))
    return raster.compare_grids(meta, "0", 0.5)


_FIELD = "SELECT DISTINCT c_nationkey AS row, CAST(c_custkey % 40 AS INTEGER) AS col, CAST(c_nationkey * 3.0 + (c_custkey % 40) * (c_nationkey % 4) AS DOUBLE) AS value FROM customer"


def _field(spark, sf):
    row, col = F.col("c_nationkey"), (F.col("c_custkey") % 40).cast("int")
    return table(spark, sf, "customer").select(row.alias("row"), col.alias("col"), (row * F.lit(3.0) + col * (row % 4)).alias("value")).distinct()


def _aligned_sql(how: str) -> str:
    """From cells of 10 units at (0, 250) to 60 x 100 cells of 4 units at (7, 243)."""
    grid = f"WITH c AS ({_FIELD}), g AS (SELECT CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, (7 + (k + 0.5) * 4) / 10.0 AS u, (250 - (243 - (r + 0.5) * 4)) / 10.0 AS v FROM range(60) a(r), range(100) b(k))"
    if how == "nearest":
        return grid + " SELECT g.row, g.col, c.value FROM g JOIN c ON c.row = floor(v) AND c.col = floor(u)"
    return grid + """, f AS (SELECT g.row, g.col, c.value, (1 - abs(v - 0.5 - c.row)) * (1 - abs(u - 0.5 - c.col)) AS w FROM g JOIN c ON c.row IN (floor(v - 0.5), floor(v - 0.5) + 1) AND c.col IN (floor(u - 0.5), floor(u - 0.5) + 1))
SELECT row, col, round(sum(w * value) / sum(w), 6) AS value FROM f WHERE w > 1e-12 GROUP BY row, col"""


@query(_aligned_sql("bilinear"))
def aligned_bilinear(spark, sf):
    out = raster.aligned(_field(spark, sf), (0.0, 250.0, 10.0), (7.0, 243.0, 4.0), 60, 100)
    return out.withColumn("value", F.round("value", 6))


@query(_aligned_sql("nearest"))
def aligned_nearest(spark, sf):
    return raster.aligned(_field(spark, sf), (0.0, 250.0, 10.0), (7.0, 243.0, 4.0), 60, 100, method="nearest")


@query(f"SELECT row, col, CAST(7.5 AS DOUBLE) AS value FROM ({_FIELD})")
def constant_raster(spark, sf):
    return raster.constant_like(_field(spark, sf), 7.5)


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.02) AS a, quantile_cont(o_totalprice, 0.98) AS b FROM orders) SELECT o_orderkey, round(greatest(0, least(1, (o_totalprice - a) / (b - a))), 6) AS unit FROM orders, q")
def stretched(spark, sf):
    return raster.stretch(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", F.round("unit", 6).alias("unit"))


@query(f"SELECT row, col, value FROM ({_FIELD}) WHERE row BETWEEN 3 AND 11 AND col BETWEEN 5 AND 21")
def raster_window(spark, sf):
    rows, cols = raster.world_window((0.0, 250.0, 10.0), (52.0, 131.0, 219.0, 219.0))
    return raster.window(_field(spark, sf), rows, cols)


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 40.0 AS x, c_nationkey * 9.0 AS y, c_mktsegment AS truth FROM customer), c AS (SELECT row, col, CAST(value AS INTEGER) % 4 AS v FROM (""" + _FIELD + """))
SELECT c_custkey, truth, CASE v WHEN 1 THEN 'bog' WHEN 2 THEN 'fen' END AS y_pred FROM p JOIN c ON c.row = floor((250 - y) / 10) AND c.col = floor(x / 10) WHERE v IN (1, 2)""")
def sampled_classes(spark, sf):
    """Points on a class raster: outside, on nodata (0) and on an unmapped class (3) they go."""
    points = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 40.0).alias("x"), (F.col("c_nationkey") * F.lit(9.0)).alias("y"), F.col("c_mktsegment").alias("truth"))
    cells = _field(spark, sf).withColumn("value", F.col("value").cast("int") % 4)
    return metrics.sampled_pairs(points, cells, {"1": "bog", "2": "fen"}, "x", "y", "truth", (10.0, 0.0, 0.0, 0.0, -10.0, 250.0), nodata=0).select("c_custkey", "truth", "y_pred")


# ------------------------------------------------------------------ split

_SPLIT = "SELECT o_orderpriority AS class, 'P' || o_custkey AS polygon, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'leftover' END AS split FROM orders"


def _splits(spark, sf):
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class"), F.concat(F.lit("P"), "o_custkey").alias("polygon"), F.year("o_orderdate").cast("string").alias("year"), F.when(k == 0, "train").when(k == 1, "val").when(k == 2, "test").otherwise("leftover").alias("split"))


@query(f"SELECT class, split, count(*) AS pixels, count(DISTINCT polygon) AS polygons, count(DISTINCT year) AS years FROM ({_SPLIT}) GROUP BY class, split")
def split_summary(spark, sf):
    return split.split_summary(_splits(spark, sf))


@query(f"""WITH s AS (SELECT class, polygon, count(DISTINCT split) FILTER (split <> 'leftover') AS s, count(DISTINCT year) FILTER (split <> 'leftover') AS y, count(*) FILTER (split <> 'leftover') AS n, count(*) AS a FROM ({_SPLIT}) GROUP BY class, polygon)
SELECT count(*) FILTER (s > 1) AS several_splits, count(*) FILTER (y > 1) AS several_years, count(*) FILTER (a > 2 AND n > 2) AS over_patch FROM s WHERE n > 0""")
def split_faults_found(spark, sf):
    """On a split that breaks every rule, so that the checks have something to find."""
    return split.split_faults(_splits(spark, sf), 2)


# ------------------------------------------------------------------ station series

_STATIONS = "SELECT l_suppkey % 4 AS station, CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS precip, CASE WHEN l_suppkey % 4 = 1 AND min(l_shipdate) < DATE '1993-01-01' THEN NULL ELSE CAST(min(l_quantity) AS DOUBLE) END AS pet FROM lineitem GROUP BY l_suppkey % 4, CAST(l_shipdate AS DATE)"


def _stations(spark, sf):
    days = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("station"), F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("precip"), F.min("l_quantity").cast("double").alias("pet"))
    return days.withColumn("pet", F.when(~((F.col("station") == 1) & (F.col("date") < F.lit("1993-01-01").cast("date"))), F.col("pet")))


@query(f"WITH d AS ({_STATIONS}), s AS (SELECT station, min(date) AS a, max(date) AS b FROM d WHERE pet IS NOT NULL GROUP BY station) SELECT d.* FROM d WHERE date >= (SELECT max(a) FROM s) AND date <= (SELECT min(b) FROM s)", dates=("date",))
def common_station_period(spark, sf):
    return timeseries.common_period(_stations(spark, sf), "station", "date", ["precip", "pet"])


_BALANCE = """SELECT l_suppkey % 3 AS station, CAST(date_trunc('month', l_shipdate) + to_months(CAST(l_partkey % 40 * 12 - 240 AS INTEGER)) AS DATE) AS month,
  CAST(sum(CAST(l_extendedprice % 997 - l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS water_balance FROM lineitem GROUP BY 1, 2"""


def balance(spark, sf):
    """Each order's day is spread over 40 years, so that every month can be fitted; sums are exact."""
    daily = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("station"), F.add_months(F.trunc("l_shipdate", "month"), (F.col("l_partkey") % 40 * 12 - 240).cast("int")).alias("month"), ((F.col("l_extendedprice") % 997) - F.col("l_quantity")).cast("decimal(18,2)").alias("v"))
    return daily.groupBy("station", "month").agg(F.sum("v").cast("double").alias("water_balance"))


def _fits_sql(scales: range) -> str:
    totals = " UNION ALL ".join(f"SELECT station, month, {k} AS k, CASE WHEN count(water_balance) OVER (PARTITION BY station ORDER BY month ROWS {k - 1} PRECEDING) = {k} THEN sum(water_balance) OVER (PARTITION BY station ORDER BY month ROWS {k - 1} PRECEDING) END AS total FROM b" for k in scales)
    pi = repr(math.pi)
    return f"""WITH b AS ({_BALANCE}), t AS ({totals}),
r AS (SELECT station, k, month(month) AS m, total AS x, row_number() OVER (PARTITION BY station, k, month(month) ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY station, k, month(month)) AS n FROM t WHERE total IS NOT NULL),
p AS (SELECT station, k, m, max(n) AS n, avg(x) AS b0, avg(i / (n - 1.0) * x) AS b1, avg(i * (i - 1.0) / ((n - 1.0) * (n - 2.0)) * x) AS b2 FROM r GROUP BY ALL),
l AS (SELECT *, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM p),
f AS (SELECT station, k, m, -t3 AS shape, CASE WHEN abs(t3) < 1e-6 THEN l2 ELSE l2 * sin(t3 * {pi}) / (t3 * {pi}) END AS scale, b0 FROM l WHERE n >= 30 AND l2 > 0 AND abs(t3) < 1),
g AS (SELECT *, CASE WHEN abs(shape) < 1e-6 THEN b0 ELSE b0 - scale * (1 / shape - {pi} / sin(shape * {pi})) END AS loc FROM f)"""


@query(_fits_sql(range(1, 4)) + " SELECT k.station, k.k, k.m, round(loc, 4) AS loc, round(scale, 4) AS scale, round(shape, 6) AS shape FROM (SELECT DISTINCT station, k, m FROM r) k LEFT JOIN g ON g.station = k.station AND g.k = k.k AND g.m = k.m")
def logistic_fits(spark, sf):
    months, out = balance(spark, sf), None
    for k in range(1, 4):
        one = timeseries.rolling_sum(months, ["station"], "month", "water_balance", k, "total").select("station", F.lit(k).alias("k"), F.month("month").alias("m"), "total")
        out = one if out is None else out.unionByName(one)
    fits = timeseries.generalised_logistic(out, ["station", "k", "m"], "total")
    return fits.select("station", "k", "m", F.round("loc", 4).alias("loc"), F.round("scale", 4).alias("scale"), F.round("shape", 6).alias("shape"))


def _horner(k: tuple[float, ...], x: str) -> str:
    out = repr(k[0])
    for v in k[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


_INDEX = _fits_sql(range(1, 4)) + f""",
z AS (SELECT t.station, t.month, t.k, t.total, (t.total - loc) / scale AS z, shape FROM t LEFT JOIN g ON g.station = t.station AND g.k = t.k AND g.m = month(t.month)),
c AS (SELECT *, greatest(least(1 / (1 + exp(CASE WHEN abs(shape) < 1e-6 THEN -z ELSE ln(greatest(1 - shape * z, 1e-300)) / shape END)), 1 - 1e-6), 1e-6) AS p FROM z),
q AS (SELECT *, p - 0.5 AS q, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM c),
s AS (SELECT station, month, k, total, CASE WHEN z IS NULL THEN NULL WHEN p < {timeseries.TAIL} THEN {_horner(timeseries.TAIL_C, 't')} / {_horner(timeseries.TAIL_D, 't')} WHEN p > 1 - {timeseries.TAIL} THEN -{_horner(timeseries.TAIL_C, 't')} / {_horner(timeseries.TAIL_D, 't')}
  ELSE q * {_horner(timeseries.MIDDLE_A, '(q * q)')} / {_horner(timeseries.MIDDLE_B, '(q * q)')} END AS spei FROM q)"""


@query(_INDEX + " SELECT station, month, k, round(total, 2) AS total, round(spei, 4) AS spei FROM s", dates=("month",))
def drought_index(spark, sf):
    out = timeseries.drought_index(balance(spark, sf), scales=range(1, 4))
    return out.select("station", "month", "k", F.round("total", 2).alias("total"), F.round("spei", 4).alias("spei"))


@query(_INDEX + """, r4 AS (SELECT station, k, month, round(spei, 4) AS spei FROM s), m AS (SELECT station, k, month(month) AS m, avg(spei) AS b FROM r4 GROUP BY ALL),
n AS (SELECT station, k, max(abs(b)) AS bias FROM m GROUP BY ALL)
SELECT r4.station, r4.k, count(spei) AS n, round(avg(spei), 4) AS mean, round(stddev_samp(spei), 4) AS std, min(spei) AS min, max(spei) AS max, count(*) FILTER (spei < -2) AS extreme_dry, count(*) FILTER (spei >= -2 AND spei < -1.5) AS severe_dry,
  count(*) FILTER (spei >= -1.5 AND spei < -1) AS moderate_dry, count(*) FILTER (spei > 1 AND spei <= 1.5) AS moderate_wet, count(*) FILTER (spei > 1.5) AS severe_wet, round(any_value(bias), 4) AS seasonal_bias
FROM r4 JOIN n ON n.station = r4.station AND n.k = r4.k GROUP BY r4.station, r4.k""")
def drought_checks(spark, sf):
    index = timeseries.drought_index(balance(spark, sf), scales=range(1, 4)).withColumn("spei", F.round("spei", 4))
    return timeseries.drought_checks(index).withColumns({c: F.round(c, 4) for c in ("mean", "std", "seasonal_bias")})
