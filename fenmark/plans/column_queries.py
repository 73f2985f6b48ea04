"""Queries of the column functions: names, ids, years, colours and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import index_tables, survey
from ..session import table
from .base import query

# ------------------------------------------------------------------ ids and names


@query("SELECT o_orderkey, 'GI_hr_' || o_orderkey AS id FROM orders")
def prefixed_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.prefixed_id("GI_hr_", F.col("o_orderkey")).alias("id"))


_PIXEL_IDS = "SELECT l_orderkey, l_linenumber, 'GI_' || CASE WHEN l_orderkey % 2 = 0 THEN 'hr_' ELSE '' END || l_orderkey || '_' || l_linenumber AS id FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, regexp_replace(id, '_[0-9]+$', '') AS polygon, array_to_string(string_split(id, '_')[1:2], '_') AS leading FROM ({_PIXEL_IDS})")
def pixel_id_parts(spark, sf):
    pixel = F.concat(F.lit("GI_"), F.when(F.col("l_orderkey") % 2 == 0, "hr_").otherwise(""), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return table(spark, sf, "lineitem").withColumn("id", pixel).select("l_orderkey", "l_linenumber", S.polygon_key(F.col("id")).alias("polygon"), S.first_tokens(F.col("id")).alias("leading"))


_RUNS = "SELECT o_orderkey, o_orderstatus || 'D' || o_custkey % 5 || '_plusOW_p80_' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'at' || o_orderkey % 7 || '_' END || '_gelderland__RD' AS run_id FROM orders"


@query(f"SELECT o_orderkey, string_split(run_id, '_')[1] AS division, nullif(regexp_extract(run_id, '_(at[0-9]+)_', 1), '') AS attempt FROM ({_RUNS})")
def run_ids(spark, sf):
    attempt = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("at"), F.col("o_orderkey") % 7, F.lit("_")))
    run = F.concat("o_orderstatus", F.lit("D"), F.col("o_custkey") % 5, F.lit("_plusOW_p80_"), attempt, F.lit("_gelderland__RD"))
    return table(spark, sf, "orders").withColumn("run_id", run).select("o_orderkey", S.run_division(F.col("run_id")).alias("division"), S.run_attempt(F.col("run_id")).alias("attempt"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'WD1' WHEN s_nationkey % 3 = 1 THEN 'HT' END AS division,
  'stack_tmp' || s_nationkey || '_Q3_2020.tif' AS renamed FROM supplier""")
def division_tokens(spark, sf):
    s = table(spark, sf, "supplier")
    token = F.when(F.col("s_nationkey") % 3 == 0, "WD1").when(F.col("s_nationkey") % 3 == 1, "HT").otherwise("none")
    folder = F.concat_ws("__", F.lit("carto"), token, F.lit("WD1x"), F.lit("HT"))
    folder = F.when(token == "none", F.regexp_replace(folder, "__HT$", "")).otherwise(folder)
    return s.select("s_suppkey", S.first_known_token(folder, ["WD1", "HT"]).alias("division"), S.insert_after_tmp(F.concat(F.lit("stack_tmp"), "s_nationkey", F.lit("_2020.tif")), "Q3").alias("renamed"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'EPSG:28992' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:' || 32601 + c_nationkey
  WHEN 3 THEN 'EPSG:' || 32601 + c_nationkey WHEN 4 THEN 'EPSG:' || 4000 + c_nationkey END AS crs FROM customer""")
def crs_names(spark, sf):
    zone = (32601 + F.col("c_nationkey")).cast("string")
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, " rd ").when(k == 1, "WGS84").when(k == 2, F.concat(F.lit("UTM"), zone)).when(k == 3, F.concat(F.lit("epsg:"), zone)).when(k == 4, (4000 + F.col("c_nationkey")).cast("string")).otherwise("unknown")
    return table(spark, sf, "customer").select("c_custkey", S.epsg_code(text).alias("crs"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 0 WHEN c_custkey % 5 = 3 THEN 1 ELSE 2 END AS n,
  CASE WHEN c_custkey % 5 = 4 THEN '' WHEN c_custkey % 5 = 3 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '|' || c_mktsegment END AS ids FROM customer""")
def id_list_cells(spark, sf):
    k, i, seg = F.col("c_custkey") % 5, F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    cell = F.when(k == 0, F.concat(F.lit("['"), i, F.lit("', '"), seg, F.lit("']"))).when(k == 1, F.concat(F.lit("["), i, F.lit(", "), seg, F.lit("]"))).when(k == 2, F.concat(i, F.lit(","), seg)).when(k == 3, i)
    return table(spark, sf, "customer").withColumn("ids", S.list_cell(cell)).select("c_custkey", F.size("ids").alias("n"), F.array_join("ids", "|").alias("ids"))


@query("""SELECT lower(replace(regexp_replace(trim(c_mktsegment), '[_ ]', '', 'g'), ' ', '')) || c_nationkey AS key, arg_min(c_name, c_custkey) AS value FROM customer GROUP BY 1""")
def first_names_by_key(spark, sf):
    named = table(spark, sf, "customer").withColumn("label", F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("_ "), F.col("c_nationkey")))
    return survey.first_by_name(named, "label", "c_name", "c_custkey")


# ------------------------------------------------------------------ years and dates


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), ',' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS years FROM lineitem GROUP BY l_orderkey")
def years_as_text(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(S.years_csv(F.collect_list(F.concat(F.lit(" "), F.year("l_shipdate").cast("string")))).alias("years"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END AS year, CAST(year(o_orderdate) AS INTEGER) AS parsed_year, CAST(quarter(o_orderdate) AS INTEGER) AS parsed_quarter,
  CAST(year(o_orderdate) = 1995 AS INTEGER) AS has_1995 FROM orders""")
def years_of_texts(spark, sf):
    o = table(spark, sf, "orders")
    y = F.year("o_orderdate").cast("string")
    year, quarter = S.year_quarter(F.date_format("o_orderdate", "yyyy-MM-dd"))
    listed = F.concat(F.lit("11995, 19950, "), y)
    return o.select("o_orderkey", S.normal_year(F.when(F.col("o_orderkey") % 3 == 0, y).otherwise(F.concat(y, F.lit("-2024")))).alias("year"), year.alias("parsed_year"), quarter.alias("parsed_quarter"), S.has_year(listed, 1995).cast("int").alias("has_1995"))


@query("SELECT o_orderkey, CAST(y AS VARCHAR) AS year FROM orders, range(2010, 2030) t(y) WHERE y BETWEEN 2012 + o_orderkey % 4 AND 2018 OR y = 2020 + o_orderkey % 3")
def years_of_rows(spark, sf):
    o = table(spark, sf, "orders")
    first = (2012 + F.col("o_orderkey") % 4).cast("string")
    text = F.concat(first, F.lit(" , ..., 2018,, "), (2020 + F.col("o_orderkey") % 3).cast("string"))
    return o.select("o_orderkey", F.explode(S.expand_years(text)).alias("year"))


_SPREAD = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS class, CAST(y AS VARCHAR) AS year FROM orders, range(2008, 2026) t(y) WHERE o_orderpriority IS NOT NULL AND (y = 2008 + o_orderkey % 17 OR y = 2009 + o_custkey % 16)"


def _spread(spark, sf):
    """Orders with a text of one or two years, badly spaced."""
    a, b = (2008 + F.col("o_orderkey") % 17).cast("string"), (2009 + F.col("o_custkey") % 16).cast("string")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("class"), F.when(a == b, a).otherwise(F.concat(a, F.lit(" ,, "), b)).alias("years"))


@query(f"SELECT class, year, string_agg(id, ',' ORDER BY id) AS ids FROM ({_SPREAD}) GROUP BY class, year")
def idx_several_years(spark, sf):
    index = index_tables.all_years(_spread(spark, sf), "class", "years", "id")
    return index_tables.as_lists(index).withColumn("ids", F.array_join("ids", ","))


@query(f"SELECT class, year, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, class, CASE WHEN year <= '2016' THEN '2010-2016' ELSE year END AS year FROM ({_SPREAD}) WHERE year >= '2010') GROUP BY class, year")
def idx_early_bucket_repeats(spark, sf):
    """An id of two early years stands twice in the bucket."""
    index = index_tables.early_bucket(_spread(spark, sf), "class", "years", "id")
    return index_tables.as_lists(index).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH x AS ({_SPREAD}), p AS (SELECT class, year, CAST(count(*) FILTER (CAST(id AS BIGINT) % 11 < CAST(year AS INTEGER) % 5) AS BIGINT) AS pixels, count(*) AS had FROM x GROUP BY class, year)
SELECT class, year, CASE WHEN pixels = 0 THEN '[-]' WHEN pixels > 999 THEN '999+' ELSE CAST(pixels AS VARCHAR) END AS shown FROM p""")
def split_difference_marks(spark, sf):
    index = index_tables.all_years(_spread(spark, sf), "class", "years", "id")
    kept = index.filter("cast(id as long) % 11 < cast(year as int) % 5").groupBy("class", "year").agg(F.count(F.lit(1)).alias("pixels"))
    return index_tables.split_marks(kept, index)


@query("""SELECT row_number() OVER (ORDER BY CASE WHEN try_cast(label AS INTEGER) IS NULL THEN 1 ELSE 0 END, try_cast(label AS INTEGER), label) AS place, label
FROM (SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN p_size || '-' || p_size ELSE CAST(p_size AS VARCHAR) END AS label FROM part)""")
def year_order(spark, sf):
    from ..operators.numbering import numbered

    label = F.when(F.col("p_size") % 4 == 0, F.concat_ws("-", F.col("p_size").cast("string"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return numbered(table(spark, sf, "part").select(label.alias("label")).distinct(), S.year_order(F.col("label")), "place").select("place", "label")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey, 'LGN_OW_' || row_number() OVER (ORDER BY p_partkey) AS id, 'Open water' AS name, CAST(100 AS INTEGER) AS pct
FROM part WHERE p_retailprice >= 905""")
def tidy_open_water(spark, sf):
    out = index_tables.tidy(table(spark, sf, "part"), ["p_partkey"], "LGN_OW", {"name": "Open water", "pct": 100}, "p_retailprice", 905)
    return out.select(F.regexp_extract("index", r"(\d+)$", 1).cast("long").alias("n"), "p_partkey", F.col("index").alias("id"), "name", "pct")


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS area, CASE WHEN o_orderkey % 3 > 0 THEN CAST(round_even(o_totalprice * (o_orderkey % 101) / 100, 0) AS BIGINT) END AS covered FROM orders""")
def cleaned_inspection(spark, sf):
    rows = table(spark, sf, "orders").withColumn("pct", F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 101).cast("string")).otherwise("none"))
    return index_tables.cleaned_areas(rows.withColumn("spare", F.lit(1)), "o_totalprice", "pct", ["spare"]).select("o_orderkey", "area", "covered")


# ------------------------------------------------------------------ colours

_RGB = "SELECT p_partkey, (p_partkey * 7919) % 256 AS r, (p_partkey * 104729) % 256 AS g, (p_partkey // 2 * 7919) % 256 AS b FROM part"


def _rgb(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", (p * 7919 % 256).alias("r"), (p * 104729 % 256).alias("g"), (F.expr("p_partkey div 2") * 7919 % 256).alias("b"))


@query(f"SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS color, printf('#%02x%02x%02x%02x', r, g, b, 128) AS with_alpha, round(r / 255.0, 9) AS r, round(g / 255.0, 9) AS g, round(b / 255.0, 9) AS b FROM ({_RGB})")
def hex_colours(spark, sf):
    c = _rgb(spark, sf)
    parts = [F.col(x) / F.lit(255.0) for x in "rgb"]
    out = c.select("p_partkey", S.rgb_hex(*parts).alias("color"), S.rgb_hex(*parts, F.lit(0.5)).alias("with_alpha"))
    rgb = S.hex_rgb(F.when(F.col("p_partkey") % 2 == 0, F.col("color")).otherwise(F.substring("with_alpha", 2, 8)))
    return out.withColumn("c", rgb).select("p_partkey", "color", "with_alpha", *[F.round(f"c.{x}", 9).alias(x) for x in "rgb"])


@query(f"""WITH c AS (SELECT p_partkey, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM ({_RGB})),
m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c)
SELECT p_partkey, round(CASE WHEN d = 0 THEN 0 WHEN hi = r AND g >= b THEN 60 * (g - b) / d WHEN hi = r THEN 360 - 60 * (b - g) / d WHEN hi = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END, 6) AS h,
  round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 9) AS s, round(hi, 9) AS v FROM m""")
def rgb_to_hsv(spark, sf):
    hsv = S.rgb_hsv(*[F.col(x) / F.lit(255.0) for x in "rgb"])
    return _rgb(spark, sf).withColumn("h", hsv).select("p_partkey", F.round("h.h", 6).alias("h"), F.round("h.s", 9).alias("s"), F.round("h.v", 9).alias("v"))


@query("""WITH h AS (SELECT p_partkey, (p_partkey * 37) % 360 AS h, p_size / 50.0 AS s, (p_partkey % 101) / 100.0 AS v FROM part),
x AS (SELECT *, v * s AS c, v * s * (1 - abs((h / 60.0) - 2 * floor(h / 120.0) - 1)) AS x, v - v * s AS m, CAST(floor(h / 60.0) AS INTEGER) AS k FROM h)
SELECT p_partkey, round(m + CASE WHEN k IN (0, 5) THEN c WHEN k IN (1, 4) THEN x ELSE 0 END, 9) AS r, round(m + CASE WHEN k IN (1, 2) THEN c WHEN k IN (0, 3) THEN x ELSE 0 END, 9) AS g,
  round(m + CASE WHEN k IN (3, 4) THEN c WHEN k IN (2, 5) THEN x ELSE 0 END, 9) AS b FROM x""")
def hsv_to_rgb(spark, sf):
    rgb = S.hsv_rgb((F.col("p_partkey") * 37 % 360).cast("double"), F.col("p_size") / F.lit(50.0), (F.col("p_partkey") % 101) / F.lit(100.0))
    return table(spark, sf, "part").withColumn("c", rgb).select("p_partkey", *[F.round(f"c.{x}", 9).alias(x) for x in "rgb"])


@query("SELECT p_partkey, round(least(greatest(r, 0), 255) / CASE WHEN greatest(r, g, b) > 1 THEN 255.0 ELSE 1.0 END, 9) AS r, CAST(0.25 AS DOUBLE) AS alpha FROM (SELECT p_partkey, p_size * 6 - 20 AS r, p_partkey % 3 AS g, 0 AS b FROM part)")
def unit_colours(spark, sf):
    cells = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 6 - 20).cast("double").alias("r"), (F.col("p_partkey") % 3).cast("double").alias("g"), F.lit(0.0).alias("b"))
    r, _, _ = S.unit_scaled([F.col("r"), F.col("g"), F.col("b")])
    return survey.with_alpha(cells.withColumn("unit", r), 0.25).select("p_partkey", F.round("unit", 9).alias("r"), "alpha")


@query("SELECT DISTINCT p_brand AS type, printf('#%06x', p_size) AS color FROM part WHERE p_size > 3")
def selection_colours(spark, sf):
    colour = F.when(F.col("p_size") > 3, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_size").cast("long"))), 6, "0")))
    return survey.selection_colours(table(spark, sf, "part").withColumn("c", colour), "p_brand", "c")
