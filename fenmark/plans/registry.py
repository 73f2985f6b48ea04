"""Every query of the analytics operators, by name, with the SQL that must give the same rows.

The driver's tables stand in for surveys and rasters: users are pixels, event types are classes, orders are polygons with
an area and a year, line items are observations of bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import area, grid, index_tables, metrics, ml, raster, split, stability, survey, timeseries
from ..session import table
from . import column_queries, file_queries, map_queries, space_queries  # noqa: F401  they register themselves
from .base import QUERIES, SQL, Query, query

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ------------------------------------------------------------------ stability

_PROFILE = """
WITH obs AS ({obs}),
cnt AS (SELECT {k}, cls, count(*) AS c FROM obs GROUP BY {k}, cls),
r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY c DESC, cls) AS rn,
  sum(c) OVER (PARTITION BY {k}) AS n, count(*) OVER (PARTITION BY {k}) AS k FROM cnt),
p AS (
  SELECT {k}, max(CASE WHEN rn = 1 THEN cls END) AS modal_class, max(CASE WHEN rn = 1 THEN c / CAST(n AS DOUBLE) END) AS modal_frequency,
    max(CASE WHEN rn = 2 THEN cls END) AS second_class, coalesce(max(CASE WHEN rn = 2 THEN c / CAST(n AS DOUBLE) END), 0.0) AS second_frequency,
    CASE WHEN max(k) = 1 THEN 0.0 ELSE round(-sum(c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE))) / log2(max(k)), 9) END AS entropy_normalized
  FROM r GROUP BY {k}),
d AS (
  SELECT *, CAST(CASE WHEN modal_frequency >= 0.8 THEN 1 WHEN modal_frequency > 0.4 AND second_frequency > 0.4 THEN 4
    WHEN modal_frequency >= 0.7 THEN 2 WHEN modal_frequency >= 0.6 THEN 3 ELSE 5 END AS INTEGER) AS decision_category FROM p)
"""
_USERS = _PROFILE.format(k="pixel_id", obs="SELECT user_id AS pixel_id, event_type AS cls FROM events")
_DAYS = _PROFILE.format(k="pixel_id, day", obs="SELECT user_id AS pixel_id, CAST(ts AS DATE) AS day, event_type AS cls FROM events")


def _daily_profile(spark: SparkSession, sf: str) -> DataFrame:
    obs = table(spark, sf, "events").select(F.col("user_id").alias("pixel_id"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("cls"))
    return stability.stability_profile(obs, ["pixel_id", "day"], "cls")


@query(_USERS + "SELECT * FROM d")
def stability_profile(spark, sf):
    obs = table(spark, sf, "events").select(F.col("user_id").alias("pixel_id"), F.col("event_type").alias("cls"))
    return stability.stability_profile(obs, ["pixel_id"], "cls")


@query(_DAYS + "SELECT pixel_id, day, modal_class, second_class, decision_category FROM d", dates=("day",))
def decision_category(spark, sf):
    return _daily_profile(spark, sf).select("pixel_id", "day", "modal_class", "second_class", "decision_category")


@query(_DAYS + "SELECT decision_category, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM d GROUP BY decision_category")
def decision_distribution(spark, sf):
    return stability.value_percentages(_daily_profile(spark, sf), "decision_category")


@query(_DAYS + """SELECT pixel_id, day, decision_category,
  CASE WHEN decision_category = 4 THEN least(modal_class, second_class) || '_' || greatest(modal_class, second_class) END AS pair,
  CASE WHEN decision_category = 4 THEN CAST(CAST('0x' || substr(md5(least(modal_class, second_class) || '_' || greatest(modal_class, second_class)), 1, 8) AS BIGINT) % 22 AS INTEGER) END AS palette
FROM d WHERE decision_category IN (4, 5)""", dates=("day",))
def unstable_pairs(spark, sf):
    return stability.unstable_pairs(_daily_profile(spark, sf), ["pixel_id", "day"])


@query(_DAYS + "SELECT pixel_id, day, modal_class, CASE WHEN modal_class = 'click' THEN '#ff0000' ELSE '#000000' END AS color, CAST(CASE WHEN decision_category = 2 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS alpha FROM d WHERE decision_category IN (1, 2)", dates=("day",))
def stable_cells(spark, sf):
    colours = spark.createDataFrame([("click", "#ff0000")], "class string, color string")
    return stability.stable_cells(_daily_profile(spark, sf), colours, ["pixel_id", "day"], [1, 2], {2: 0.5})


@query("SELECT event_type AS value, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM events GROUP BY event_type")
def value_percentages(spark, sf):
    return stability.value_percentages(table(spark, sf, "events").select(F.col("event_type").alias("value")), "value")


# ------------------------------------------------------------------ index tables

_POLYGONS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS class, CAST(year(o_orderdate) + 20 AS VARCHAR) AS year, o_orderstatus AS status, o_totalprice AS price FROM orders"


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as polygons: their years lie in 2012 to 2018."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("class"), (F.year("o_orderdate") + 20).cast("string").alias("years"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return index_tables.all_years(_polygons(spark, sf), "class", "years", "id")


_LISTS = "SELECT class, year, string_agg(id, ',' ORDER BY id) AS ids FROM x GROUP BY class, year"


def _lists(index: DataFrame) -> DataFrame:
    return index_tables.as_lists(index).withColumn("ids", F.array_join("ids", ","))


@query(f"WITH x AS ({_POLYGONS}) {_LISTS}")
def idx_tmp0(spark, sf):
    return _lists(_index(spark, sf))


@query(f"WITH x AS (SELECT id, class, CASE WHEN year BETWEEN '2010' AND '2016' THEN '2010-2016' ELSE year END AS year FROM ({_POLYGONS}) WHERE year >= '2010') {_LISTS}")
def idx_tmp1(spark, sf):
    return _lists(index_tables.early_bucket(_polygons(spark, sf), "class", "years", "id"))


@query(f"WITH x AS (SELECT * FROM ({_POLYGONS}) WHERE year BETWEEN '2017' AND '2024') {_LISTS}")
def idx_tmp2(spark, sf):
    return _lists(index_tables.selected_years(_polygons(spark, sf), "class", "years", "id"))


@query(f"WITH x AS ({_POLYGONS}) SELECT class, " + ", ".join(f"coalesce(string_agg(id, ',' ORDER BY id) FILTER (year = '{y}'), '') AS y{y}" for y in (2017, 2018, 2019)) + " FROM x GROUP BY class")
def idx_wide(spark, sf):
    out = index_tables.wide(_index(spark, sf), ["2017", "2018", "2019"])
    return out.select("class", *[F.array_join(y, ",").alias(f"y{y}") for y in ("2017", "2018", "2019")])


@query(f"WITH x AS (SELECT * FROM ({_POLYGONS}) WHERE status IN ('F', 'O')) {_LISTS}")
def idx_habitat_filter(spark, sf):
    reference = spark.createDataFrame([("F",), ("O",)], "status string")
    rows = _polygons(spark, sf)
    return _lists(index_tables.known_codes(_index(spark, sf), rows, reference, "id", "status"))


@query(f"WITH p AS ({_POLYGONS}), c AS (SELECT DISTINCT class FROM p) SELECT c.class, year, count(id) AS n FROM c LEFT JOIN (SELECT * FROM p WHERE price >= 200000) q ON q.class = c.class GROUP BY c.class, year")
def idx_full_cover(spark, sf):
    out = index_tables.full_cover(_index(spark, sf), _polygons(spark, sf), "id", "price", 200000)
    return out.groupBy("class", "year").agg(F.count("id").alias("n"))


_REGIONS = f"""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) + 20 AS VARCHAR) AS year, c_nationkey AS code
  FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT DISTINCT r_name AS class, year, id FROM p JOIN nation ON n_nationkey = code JOIN region ON r_regionkey = n_regionkey)"""


@query(f"{_REGIONS} {_LISTS}")
def idx_group(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    rows = _polygons(spark, sf).join(customers, F.col("cust") == F.col("c_custkey"))
    lookup = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("code"), F.col("r_name").alias("division"))
    return _lists(index_tables.regrouped(_index(spark, sf), rows, lookup, "id", "code", "division"))


@query(f"SELECT class, year, CAST(sum(floor(price / 100)) AS BIGINT) AS pixels FROM ({_POLYGONS}) GROUP BY class, year")
def pixel_count(spark, sf):
    return index_tables.pixel_count(_index(spark, sf), _polygons(spark, sf), "id", "price")


@query(f"SELECT class, count(*) AS n_ids, round_even(CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) / 100, 2) AS area FROM ({_POLYGONS}) GROUP BY class")
def unique_area(spark, sf):
    rows = _polygons(spark, sf).withColumn("price", F.col("price").cast("decimal(18,2)"))
    out = index_tables.unique_area(_index(spark, sf), rows, "id", "price", 1)
    return out.withColumn("area", F.bround(F.col("area").cast("double") / 100, 2))


@query(f"SELECT class AS type, id, string_agg(DISTINCT year, ',' ORDER BY year) AS years FROM ({_POLYGONS}) GROUP BY class, id")
def idx_to_rows(spark, sf):
    return index_tables.to_rows(_index(spark, sf))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS id FROM orders EXCEPT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 20")
def missing_ids(spark, sf):
    index = _polygons(spark, sf).select("class", F.col("years").alias("year"), F.col("cust").cast("string").alias("id"))
    known = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("cust"))
    return index_tables.missing_ids(index, known, "cust")


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'unknown') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def ref_lookup_default(spark, sf):
    dim = table(spark, sf, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return index_tables.with_default(table(spark, sf, "nation"), dim, "n_regionkey", "r_name", "unknown").select("n_nationkey", "n_name", "r_name")


@query("SELECT n_regionkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_strict(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    return index_tables.union_strict(a, table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("""WITH f AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1)
SELECT r_regionkey AS k, CAST(5 + r_regionkey % 2 AS BIGINT) AS expected, n AS found FROM region LEFT JOIN f ON k = r_regionkey WHERE n IS DISTINCT FROM 5 + r_regionkey % 2""")
def golden_count_check(spark, sf):
    found = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    expected = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), (F.lit(5) + F.col("r_regionkey") % 2).cast("long").alias("n"))
    return index_tables.golden_check(found, expected, ["k"])


# ------------------------------------------------------------------ metrics

_PAIRS = "SELECT year(l_shipdate) AS year, 'Q' || quarter(l_shipdate) AS timeframe, l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS pred FROM lineitem"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.concat(F.lit("Q"), F.quarter("l_shipdate")).alias("timeframe"), F.col("l_returnflag").alias("truth"), F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R").alias("pred"))


def _scores_sql(keys: str) -> str:
    return f"""WITH p AS ({_PAIRS}),
u AS (SELECT {keys}, truth AS class, CAST(truth = pred AS INTEGER) AS tp, 1 AS n, 0 AS m FROM p UNION ALL SELECT {keys}, pred, 0, 0, 1 FROM p),
c AS (SELECT {keys}, class, CAST(sum(tp) AS DOUBLE) AS tp, sum(n) AS n, sum(m) AS m FROM u GROUP BY {keys}, class),
s AS (SELECT {keys}, class, coalesce(tp / nullif(m, 0), 0) AS pr, coalesce(tp / nullif(n, 0), 0) AS re, coalesce(2 * tp / nullif(n + m, 0), 0) AS f1, tp, CAST(n AS BIGINT) AS n FROM c)"""


_ACCURACY = "SELECT {k}, CAST(sum(n) AS BIGINT) AS n, round_even(sum(tp) / sum(n), 2) AS acc, round_even(avg(f1), 2) AS macro_f1, round_even(sum(f1 * n) / sum(n), 2) AS weighted_f1 FROM s GROUP BY {k}"


@query(f"SELECT year, truth, pred, count(*) AS c FROM ({_PAIRS}) GROUP BY year, truth, pred")
def confusion_by_year(spark, sf):
    return metrics.confusion(_pairs(spark, sf), ["year"], "truth", "pred")


@query(_scores_sql("year") + _ACCURACY.format(k="year"))
def accuracy_by_year(spark, sf):
    return metrics.accuracy(_pairs(spark, sf), ["year"], "truth", "pred")


@query(_scores_sql("year") + "SELECT year, class, CASE WHEN n > 0 THEN round_even(pr, 2) END AS precision, CASE WHEN n > 0 THEN round_even(re, 2) END AS recall, CASE WHEN n > 0 THEN round_even(f1, 2) END AS f1, n FROM s")
def per_class_prf(spark, sf):
    return metrics.class_scores(_pairs(spark, sf), ["year"], "truth", "pred")


@query(_scores_sql("year") + "SELECT year, " + ", ".join(f"max(CASE WHEN class = '{c}' AND n > 0 THEN round_even({e}, 2) END) AS {m}_{c}" for c in "ANR" for m, e in (("prec", "pr"), ("rec", "re"), ("f1", "f1"))) + ", " + ", ".join(f"max(CASE WHEN class = '{c}' THEN n END) AS n_{c}" for c in "ANR") + " FROM s GROUP BY year")
def per_class_wide(spark, sf):
    return metrics.wide_scores(metrics.class_scores(_pairs(spark, sf), ["year"], "truth", "pred"), ["year"], list("ANR"))


_QUARTERS = _scores_sql("year, timeframe") + ", q AS (" + _ACCURACY.format(k="year, timeframe") + ") "
_W = "CAST(CASE timeframe WHEN 'Q1' THEN 0.1 WHEN 'Q2' THEN 0.4 WHEN 'Q3' THEN 0.4 ELSE 0.1 END AS DECIMAL(18, 9))"


@query(_QUARTERS + f"SELECT year, round_even(CAST(sum(CAST(acc AS DECIMAL(18, 9)) * {_W}) AS DOUBLE) / CAST(sum({_W}) AS DOUBLE), 2) AS acc, round_even(CAST(sum(CAST(macro_f1 AS DECIMAL(18, 9)) * {_W}) AS DOUBLE) / CAST(sum({_W}) AS DOUBLE), 2) AS macro_f1, CAST(round_even(avg(n), 0) AS BIGINT) AS n FROM q GROUP BY year")
def year_weighted_average(spark, sf):
    per = metrics.accuracy(_pairs(spark, sf), ["year", "timeframe"], "truth", "pred")
    return metrics.weighted_year_average(per, {"Q1": 0.1, "Q2": 0.4, "Q3": 0.4, "Q4": 0.1}, "year", "timeframe", ["acc", "macro_f1"], ["n"])


@query(_QUARTERS + "SELECT year, round_even(avg(acc), 2) AS acc, round_even(avg(macro_f1), 2) AS macro_f1, CAST(sum(n) AS BIGINT) AS n FROM q WHERE timeframe = 'Q2' GROUP BY year")
def timeframe_average(spark, sf):
    per = metrics.accuracy(_pairs(spark, sf), ["year", "timeframe"], "truth", "pred")
    return metrics.timeframe_average(per, "Q2", "year", "timeframe", ["acc", "macro_f1"], ["n"])


@query(_scores_sql("year") + "SELECT class, year, round_even(avg(CASE WHEN n > 0 THEN round_even(f1, 2) END), 2) AS score, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY class, year")
def score_heatmap(spark, sf):
    return metrics.scores_by_class_and_year(metrics.class_scores(_pairs(spark, sf), ["year"], "truth", "pred"), "year", "f1")


@query("SELECT o_orderkey, lower(regexp_replace(trim(o_orderpriority), '\\.0$', '')) AS label, regexp_replace(o_orderpriority, '[ /\\\\]', '_', 'g') AS suffix, lower(regexp_replace(trim(o_orderpriority), '[_ ]', '', 'g')) AS bare FROM orders")
def label_cleaning(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.clean_label(F.col("o_orderpriority")).alias("label"), S.column_suffix(F.col("o_orderpriority")).alias("suffix"), S.bare_name(F.col("o_orderpriority")).alias("bare"))


# ------------------------------------------------------------------ area

_SHARES = "WITH c AS (SELECT l_suppkey % 10 AS location, year(l_shipdate) AS year, 'Q' || quarter(l_shipdate) AS timeframe, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT location, year, timeframe, class, n / CAST(sum(n) OVER (PARTITION BY location, year, timeframe) AS DOUBLE) AS share FROM c) "


def _shares(spark: SparkSession, sf: str, class_map: dict | None = None) -> DataFrame:
    cells = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("location"), F.year("l_shipdate").alias("year"), F.concat(F.lit("Q"), F.quarter("l_shipdate")).alias("timeframe"), F.col("l_returnflag").alias("cls"))
    return area.class_shares(cells, ["location", "year", "timeframe"], "cls", class_map)


@query(_SHARES + "SELECT k.location, k.year, k.timeframe, m.class, coalesce(s.share, 0.0) AS share FROM (SELECT DISTINCT location, year, timeframe FROM s) k, (VALUES ('A', 'accepted'), ('R', 'returned'), ('X', 'none')) m(v, class) LEFT JOIN s ON s.location = k.location AND s.year = k.year AND s.timeframe = k.timeframe AND s.class = m.v")
def class_share(spark, sf):
    return _shares(spark, sf, {"A": "accepted", "R": "returned", "X": "none"})


@query(_SHARES + "SELECT location, year, timeframe, class, share, year + (CAST(substr(timeframe, 2) AS INTEGER) - 0.5) / 4 AS t FROM s")
def quarterly_timeline(spark, sf):
    return area.quarterly_timeline(_shares(spark, sf), "year", "timeframe", ["Q1", "Q2", "Q3", "Q4"])


@query(_SHARES + "SELECT location, year, timeframe, class, round(sum(share) OVER (PARTITION BY location, year, timeframe ORDER BY class ROWS UNBOUNDED PRECEDING), 9) AS top FROM s")
def cumulative_share(spark, sf):
    out = area.cumulative_shares(_shares(spark, sf), ["location", "year", "timeframe"])
    return out.select("location", "year", "timeframe", "class", F.round("top", 9).alias("top"))


# ------------------------------------------------------------------ raster


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) / (l_extendedprice + l_quantity + 1e-6), 9) AS ndvi, round((l_tax - l_quantity) / (l_tax + l_quantity + 1e-6), 9) AS ndwi FROM lineitem")
def ndvi(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(raster.ndvi(F.col("l_quantity"), F.col("l_extendedprice")), 9).alias("ndvi"), F.round(raster.ndwi(F.col("l_tax"), F.col("l_quantity")), 9).alias("ndwi"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) > 1e-10 THEN l_tax / l_discount END AS ratio FROM lineitem")
def vv_vh_ratio(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raster.ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(10 * log10(greatest(value, 1e-10)), 9) END AS db FROM events")
def to_db(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(raster.to_db(F.col("value")), 9).alias("db"))


_CELLS = "SELECT user_id % 12 AS row, user_id // 12 AS col, year(ts) AS year, quarter(ts) AS quarter, month(ts) AS month, CAST(ts AS DATE) AS day, event_id, event_type, value FROM events"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 12).alias("row"), F.expr("user_id div 12").alias("col"), F.col("ts").cast("date").alias("day"), "event_id", "event_type", "value")


@query(f"SELECT row, col, year, quarter, count(*) AS n, round_even(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS mean FROM ({_CELLS}) GROUP BY row, col, year, quarter")
def quarterly_mean(spark, sf):
    cells = _cells(spark, sf).withColumns({"year": F.year("day"), "quarter": F.quarter("day")})
    return raster.period_stats(cells, ["row", "col", "year", "quarter"], "value", decimals=2).select("row", "col", "year", "quarter", "n", F.bround("mean", 6).alias("mean"))


@query(f"SELECT row, col, year, quarter, median(value) AS median, min(value) AS min, max(value) AS max FROM ({_CELLS}) GROUP BY row, col, year, quarter")
def quarterly_median(spark, sf):
    return raster.quarterly(_cells(spark, sf), "day", "value", ["row", "col"]).select("row", "col", "year", "quarter", "median", "min", "max")


@query(f"SELECT row, col, year, quarter, round(stddev_samp(value), 6) AS std FROM ({_CELLS}) GROUP BY row, col, year, quarter")
def quarterly_std(spark, sf):
    return raster.quarterly(_cells(spark, sf), "day", "value", ["row", "col"]).select("row", "col", "year", "quarter", F.round("std", 6).alias("std"))


@query(f"SELECT row, col, year, month, count(value) AS n, round(stddev_samp(value), 6) AS std FROM ({_CELLS}) GROUP BY row, col, year, month")
def monthly_std(spark, sf):
    return raster.monthly(_cells(spark, sf), "day", "value", ["row", "col"]).select("row", "col", "year", "month", "n", F.round("std", 6).alias("std"))


@query("SELECT o_orderkey, CAST(trunc(greatest(least(o_totalprice - 100000, 32767.0), -32768.0)) AS SMALLINT) AS v FROM orders")
def int16_clamp(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.to_int16(F.col("o_totalprice") - 100000).alias("v"))


@query(f"SELECT row, col, arg_min(value, event_id) AS value FROM ({_CELLS}) GROUP BY row, col")
def mosaic_first(spark, sf):
    return raster.mosaic_first(_cells(spark, sf), "value", "event_id")


@query(f"WITH c AS (SELECT row, col, event_type, max(value) AS v FROM ({_CELLS}) GROUP BY ALL) SELECT a.row, a.col, a.v AS click, b.v AS view FROM (SELECT * FROM c WHERE event_type = 'click') a JOIN (SELECT * FROM c WHERE event_type = 'view') b ON a.row = b.row AND a.col = b.col")
def stack_join(spark, sf):
    one = _cells(spark, sf).groupBy("row", "col", "event_type").agg(F.max("value").alias("value"))
    return raster.stack(one, ["click", "view"], "event_type")


@query(f"WITH c AS (SELECT row, col, max(value) AS value FROM ({_CELLS}) GROUP BY ALL) SELECT row * 2 + i AS row, col * 2 + j AS col, value FROM c, range(2) a(i), range(2) b(j)")
def upsample(spark, sf):
    return raster.upsampled(_cells(spark, sf).groupBy("row", "col").agg(F.max("value").alias("value")), 2)


@query(f"WITH c AS (SELECT row // 3 AS row, col // 3 AS col, event_type AS value, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM c QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1")
def downsample_mode(spark, sf):
    return raster.downsampled(_cells(spark, sf).withColumnRenamed("event_type", "v"), 3, "v", "mode").withColumnRenamed("v", "value")


@query(f"SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS v FROM events")
def reclass(spark, sf):
    return table(spark, sf, "events").select("event_id", raster.reclass(F.when(F.col("event_type") == "click", 16).otherwise(1), 16).cast("int").alias("v"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END AS value, CAST(s_nationkey % 2 = 0 AS INTEGER) AS valid FROM supplier""")
def mask_cells(spark, sf):
    s = table(spark, sf, "supplier")
    cells = s.select("s_suppkey", F.col("s_nationkey").alias("row"), F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("value"))
    inside = s.filter("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("row"), F.col("s_suppkey").alias("col"))
    return raster.masked(cells, inside).select("s_suppkey", "value", F.col("valid").cast("int").alias("valid"))


# ------------------------------------------------------------------ time series

_DAILY = "SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS precip_mm, count(*) AS pet_mm FROM orders GROUP BY 1, 2"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.col("o_orderdate").cast("date").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("precip_mm"), F.count(F.lit(1)).cast("double").alias("pet_mm"))


_MONTHS = f"""WITH d AS ({_DAILY}), h AS (SELECT station, date_trunc('month', date) AS month, sum(pet_mm) AS pet_mm, count(*) AS k FROM d GROUP BY 1, 2),
g AS (SELECT station, min(month) AS a, max(month) AS b FROM h GROUP BY 1),
s AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM g),
m AS (SELECT s.station, CAST(s.month AS DATE) AS month, CASE WHEN coalesce(k, 0) >= 0.5 * day(last_day(s.month)) THEN CAST(pet_mm AS DOUBLE) END AS pet_mm FROM s LEFT JOIN h ON h.station = s.station AND h.month = s.month)"""


@query(_MONTHS + "SELECT * FROM m", dates=("month",))
def monthly_coverage_sum(spark, sf):
    return timeseries.monthly_sums(_daily(spark, sf), "station", "date", ["pet_mm"], 0.5)


@query(_MONTHS + "SELECT station, month, pet_mm, CASE WHEN count(pet_mm) OVER w = 3 THEN sum(pet_mm) OVER w END AS sum3 FROM m WINDOW w AS (PARTITION BY station ORDER BY month ROWS 2 PRECEDING)", dates=("month",))
def rolling_k(spark, sf):
    months = timeseries.monthly_sums(_daily(spark, sf), "station", "date", ["pet_mm"], 0.5)
    return timeseries.rolling_sum(months, ["station"], "month", "pet_mm", 3, "sum3")


# ------------------------------------------------------------------ grids

_BOXES = "SELECT p_partkey, CAST(p_partkey % 40 AS DOUBLE) AS xmin, CAST(p_partkey // 40 % 40 AS DOUBLE) AS ymin, p_partkey % 40 + p_size / 10.0 AS xmax, p_partkey // 40 % 40 + p_size / 15.0 AS ymax FROM part"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("p_partkey") % 40, F.expr("p_partkey div 40 % 40")
    return table(spark, sf, "part").select("p_partkey", x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + F.col("p_size") / F.lit(10.0)).alias("xmax"), (y + F.col("p_size") / F.lit(15.0)).alias("ymax"))


@query(f"WITH b AS ({_BOXES}) SELECT p_partkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM b, range(0, 60) y(r), range(0, 60) x(c) WHERE r >= ymin AND r + 1 <= floor(ymax) AND c >= xmin AND c + 1 <= floor(xmax)")
def pixelize_grid(spark, sf):
    return grid.pixelized(_boxes(spark, sf), "p_partkey").select("p_partkey", "row", "col")


@query(f"WITH p AS (SELECT s_suppkey, floor(s_acctbal / 1000) AS row, s_nationkey AS col FROM supplier), c AS (SELECT user_id % 12 AS row, user_id // 12 AS col, max(value) AS value FROM events GROUP BY 1, 2) SELECT s_suppkey, value FROM p JOIN c ON c.row = p.row AND c.col = p.col")
def point_sample(spark, sf):
    cells = _cells(spark, sf).groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.max("value").alias("value"))
    row, col = S.row_col(F.col("s_nationkey").cast("double"), -F.col("s_acctbal"), (1.0, 0.0, 0.0, 0.0, -1000.0, 0.0))
    return grid.point_cells(table(spark, sf, "supplier"), cells, row, col).select("s_suppkey", "value")


@query("WITH c AS (SELECT DISTINCT c_nationkey AS row, c_custkey // 3 AS col FROM customer), s AS (SELECT row + i AS row, col + j AS col, row AS r0, col AS c0 FROM c, range(-1, 2) x(i), range(-1, 2) y(j) WHERE i <> 0 OR j <> 0) SELECT c.row, c.col, count(s.row) AS neighbours FROM c LEFT JOIN s ON s.row = c.row AND s.col = c.col GROUP BY c.row, c.col")
def grid_neighbours(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_nationkey").alias("row"), F.expr("c_custkey div 3").alias("col"))
    return grid.neighbour_counts(cells)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT c_nationkey AS row, c_custkey // 4 AS col FROM customer), n AS (SELECT row, col, CAST(row AS BIGINT) * 100000000 + col AS id FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM (SELECT id, row + i AS row, col + j AS col FROM n, range(-1, 2) x(i), range(-1, 2) y(j)) a JOIN n b ON b.row = a.row AND b.col = a.col),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT row, col, CAST(min(b) AS BIGINT) AS region FROM n JOIN r ON r.a = n.id GROUP BY row, col""")
def connected_regions(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_nationkey").alias("row"), F.expr("c_custkey div 4").alias("col"), F.lit(1).alias("value")).distinct()
    return grid.regions(cells, width=100_000_000).select("row", "col", "region")


# ------------------------------------------------------------------ surveys and maps


@query("""SELECT coalesce(a.date, b.date) AS date, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS lines
FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1) b ON a.date = b.date""", dates=("date",))
def survey_counts_full_outer(spark, sf):
    o, l = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date")), table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"))  # noqa: E741
    return survey.per_day_of({"orders": o, "lines": l})


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 300", dates=("date",))
def minimum_count_days(spark, sf):
    return survey.per_day(table(spark, sf, "events"), "ts", 300)


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT event_type) AS n_sources, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY 1", dates=("date",))
def sources_per_day(spark, sf):
    return survey.sources_per_day(table(spark, sf, "events"), "ts", "event_type").withColumn("sources", F.array_join("sources", ","))


@query("SELECT event_id, CAST(ts - INTERVAL 1 HOUR AS DATE) AS date, CAST(year(ts - INTERVAL 1 HOUR) AS VARCHAR) AS years, CAST(month(ts - INTERVAL 1 HOUR) AS VARCHAR) AS month FROM events", dates=("date",))
def survey_standardised(spark, sf):
    return survey.standardised(table(spark, sf, "events"), "ts", hours=-1).select("event_id", "date", "years", "month")


@query("WITH y AS (SELECT DISTINCT o_custkey % 1000 AS raster, year(o_orderdate) AS year FROM orders) SELECT CAST(year AS INTEGER) AS year, count(*) AS n, count(*) = (SELECT count(DISTINCT raster) FROM y) AS in_all FROM y GROUP BY year")
def year_set_ops(spark, sf):
    y = table(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("raster"), F.year("o_orderdate").alias("year"))
    return survey.year_sets(y)


@query("WITH y AS (SELECT DISTINCT o_custkey AS raster, year(o_orderdate) AS year FROM orders), g AS (SELECT raster, min(year) AS a, max(year) AS b FROM y GROUP BY 1), s AS (SELECT raster, unnest(range(a, b + 1)) AS year FROM g) SELECT s.raster, s.year FROM s ANTI JOIN y ON y.raster = s.raster AND y.year = s.year")
def missing_years(spark, sf):
    y = table(spark, sf, "orders").select(F.col("o_custkey").alias("raster"), F.year("o_orderdate").alias("year")).distinct()
    return survey.missing_years(y)


@query("SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 1 AND day(o_orderdate) = 1")
def first_of_january(spark, sf):
    return survey.first_of_january(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey")


@query("SELECT p_partkey, y AS year FROM part, (VALUES (2018), (2019), (2020)) v(y) UNION ALL SELECT p_partkey, 2021 FROM part")
def ellipsis_years(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(S.expand_years(F.lit("2018, ..., 2020, 2021"))).alias("year")).withColumn("year", F.col("year").cast("int"))


# ------------------------------------------------------------------ split and classification


def _split(spark: SparkSession, sf: str) -> DataFrame:
    box = _boxes(spark, sf).withColumn("id", F.concat(F.lit("GI_"), F.col("p_partkey").cast("string")))
    pixels = grid.pixelized(box, "id")
    cells = pixels.select(F.col("pixel_id").alias("id"), "row", "col")
    index = pixels.hint("merge").join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.col("p_brand").alias("class"), (2017 + F.col("p_partkey") % 4).cast("string").alias("year"), F.col("pixel_id").alias("id"))
    return split.train_val_split(index, cells, split.SplitPlan(cap=100, shares=(0.6, 0.3, 0.1), large=6))


@query()
def train_val_split(spark, sf):
    return _split(spark, sf)


@query("SELECT CAST(0 AS BIGINT) AS several_splits, CAST(0 AS BIGINT) AS several_years, CAST(0 AS BIGINT) AS over_patch")
def split_invariants(spark, sf):
    return split.split_faults(_split(spark, sf), 6)


@query()
def random_forest(spark, sf):
    """Trained on a documented half (a hash of the id), with all components as bands and the operator's own defaults; all rows are predicted."""
    rows = table(spark, sf, "embeddings")
    n = rows.agg(F.max(F.size("embedding"))).first()[0]
    bands = [f"b{i}" for i in range(n)]
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].alias(b) for i, b in enumerate(bands)])
    model = ml.train_forest(rows.filter("pmod(xxhash64(vec_id), 2) = 0"), bands, "label")
    return ml.predict(model, rows, bands).select("vec_id", "label", "pred", "probability")
