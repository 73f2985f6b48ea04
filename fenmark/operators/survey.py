"""Standardising survey rows, counting them per day, and preparing rows for maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bare_name, epsg_code, expand_years, has_year, unit_scaled


def standardised(rows: DataFrame, ts: str, names: dict[str, str] | None = None, hours: int = 0) -> DataFrame:
    """rows renamed, with date (the time shifted by hours, cut to its day), years and month as text."""
    out = rows.withColumnsRenamed(names or {})
    day = F.to_date(F.col(ts) + F.expr(f"interval {hours} hours"))
    return out.withColumns({"date": day, "years": F.year(day).cast("string"), "month": F.month(day).cast("string")})


def per_day(rows: DataFrame, day: str = "date", least: int = 1) -> DataFrame:
    """date and n of days with at least so many rows."""
    return rows.groupBy(F.col(day).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def per_day_of(tables: dict[str, DataFrame], day: str = "date") -> DataFrame:
    """date and a count a table, 0 where it has none: tables are counted apart, then joined outer."""
    counted = [per_day(t, day).withColumnRenamed("n", name) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, "date", "full"), counted).na.fill(0, list(tables))


def sources_per_day(rows: DataFrame, day: str, source: str) -> DataFrame:
    """date, n, n_sources and the sorted distinct sources."""
    return rows.groupBy(F.col(day).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("n_sources"), F.array_sort(F.collect_set(source)).alias("sources"))


def first_of_january(rows: DataFrame, day: str) -> DataFrame:
    """rows of the first day of a year, whose survey date is often only a year."""
    return rows.filter((F.month(day) == 1) & (F.day(day) == 1))


def map_rows(rows: DataFrame, reference: DataFrame, code: str, division: str, years: str = "years") -> DataFrame:
    """rows with their division (those without one go) and one row for each of their years."""
    table = reference.select(F.col(code).alias("m_code"), F.col(division).alias(division)).dropna().dropDuplicates(["m_code"])
    return rows.join(table, F.col(code) == F.col("m_code")).drop("m_code").withColumn("year", F.explode(expand_years(F.col(years))))


def without_types(colours: DataFrame, types: list[str], column: str = "type") -> DataFrame:
    """colours without the rows of some types; rows without a type go too."""
    return colours.filter(~F.col(column).isin(types))


def selection_colours(reference: DataFrame, division: str, colour: str) -> DataFrame:
    """type and color, distinct, without nulls."""
    return reference.select(F.col(division).alias("type"), F.col(colour).alias("color")).dropna().distinct()


def of_year(rows: DataFrame, year: int, years: str = "years") -> DataFrame:
    """rows whose text of years holds the year."""
    return rows.filter(has_year(F.col(years), year))


def features_of_years(features: DataFrame, years: list[int]) -> DataFrame:
    """Every feature for every year."""
    return features.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))


def coloured(cells: DataFrame, colours: DataFrame, value: str, key: str = "value", alpha: dict[int, float] | None = None) -> DataFrame:
    """cells with color and alpha; values without a colour are transparent."""
    table = colours.select(F.col(key).alias("k"), F.col("color").alias("c_color"))
    out = cells.join(table, F.col(value) == F.col("k"), "left")
    shade = F.when(F.col("c_color").isNull(), 0.0)
    for k, v in (alpha or {}).items():
        shade = shade.when(F.col(value) == k, v)
    return out.withColumns({"color": F.coalesce("c_color", F.lit("#000000")), "alpha": shade.otherwise(1.0)}).drop("k", "c_color")


def class_map(tags: DataFrame, column: str = "tags") -> DataFrame:
    """raster, value and class of the JSON class map in a raster's tags, under either spelling of its name."""
    raw = F.coalesce(F.col(column)["CLASS-MAP"], F.col(column)["CLASS_MAP"])
    return tags.select("raster", F.explode(F.from_json(raw, "map<string,string>")).alias("value", "class")).withColumn("value", F.col("value").try_cast("int"))


def band_years(bands: DataFrame, description: str = "description") -> DataFrame:
    """raster, year and bands (their numbers) from four-digit years in band descriptions."""
    y = F.regexp_extract(description, r"(20\d{2})", 1)
    return bands.withColumn("y", y).filter("y <> ''").groupBy("raster", F.col("y").cast("int").alias("year")).agg(F.array_sort(F.collect_list("band")).alias("bands"))


def missing_years(mapping: DataFrame) -> DataFrame:
    """raster and year between its first and last year that it lacks."""
    span = mapping.groupBy("raster").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select("raster", F.explode(F.sequence("a", "b")).alias("year")).join(mapping.select("raster", "year"), ["raster", "year"], "left_anti")


def year_sets(mapping: DataFrame, key: str = "raster", year: str = "year") -> DataFrame:
    """year, n and whether all keys have it: the union of the keys' years, with the intersection marked."""
    total = mapping.select(key).distinct().agg(F.count(F.lit(1)).alias("total"))
    per = mapping.groupBy(year).agg(F.count_distinct(key).alias("n"))
    # One row is joined to all.
    return per.join(F.broadcast(total), F.lit(True)).select(year, "n", (F.col("n") == F.col("total")).alias("in_all"))


def first_by_name(reference: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """key and value: for each bare name (lower-cased, without spaces and underscores) the first value by order."""
    rows = reference.filter(F.col(name).isNotNull()).select(bare_name(F.col(name)).alias("key"), F.col(value).alias("value"), F.col(order).alias("o"))
    return rows.groupBy("key").agg(F.min_by("value", "o").alias("value"))


def with_class_map(meta: DataFrame, classes: dict[int, str], column: str = "tags") -> DataFrame:
    """meta whose tags hold a class map, unless they have one."""
    text = F.to_json(F.create_map(*[F.lit(str(x)) for kv in classes.items() for x in kv]))
    have = F.map_contains_key(column, "CLASS-MAP") | F.map_contains_key(column, "CLASS_MAP")
    return meta.withColumn(column, F.when(have, F.col(column)).otherwise(F.map_concat(column, F.create_map(F.lit("CLASS-MAP"), text))))


def legend(meta: DataFrame, column: str = "tags") -> DataFrame:
    """raster, class and color of the JSON legend in a raster's tags."""
    return meta.select("raster", F.explode(F.from_json(F.col(column)["LEGEND"], "map<string,string>")).alias("class", "color"))


# ------------------------------------------------------------------ maps


def of_timeframe(rows: DataFrame, period: str, column: str = "timeframe") -> DataFrame:
    """rows of one period."""
    return rows.filter(F.col(column) == period)


def chosen(table: dict, keys: list, allow_missing: bool = False) -> dict:
    """The entries of a configuration for some keys, in their order; unknown keys are an error unless they are allowed."""
    missing = [k for k in keys if k not in table]
    if missing and not allow_missing:
        raise KeyError(f"unknown keys: {missing}")
    return {k: table[k] for k in keys if k in table}


def windows(spark: SparkSession, boxes: dict[str, tuple[float, float, float, float]], epsg: dict[str, str], default: str = "EPSG:28992") -> DataFrame:
    """location, epsg (normalised; the default where none is given) and geometry of map windows given by their bounds."""
    from .geometry import box_polygon, dump_wkb

    rows = [(name, epsg.get(name) or default, dump_wkb(box_polygon(*b))) for name, b in boxes.items()]
    return spark.createDataFrame(rows, "location string, epsg string, geometry binary").withColumn("epsg", epsg_code(F.col("epsg")))


def in_windows(features: DataFrame, windows: DataFrame, years: list[int] | None = None, geometry: str = "geometry", size: float = 1000.0) -> DataFrame:
    """location and the whole features that share area with its window, once for each of the years that they have (column year) if years are given."""
    from .geometry import meeting

    if years is not None:
        wanted = F.array(*[F.lit(y) for y in years])
        own = F.filter(wanted, lambda y: F.array_contains(F.transform(expand_years(F.col("years")), lambda t: t.try_cast("int")), y))
        features = features.withColumn("year", F.explode(own))
    return meeting(features, windows.select("location", F.col("geometry").alias("w_geometry")), geometry, "w_geometry", size)


def with_alpha(cells: DataFrame, alpha: float) -> DataFrame:
    """cells with one alpha for all."""
    return cells.withColumn("alpha", F.lit(float(alpha)))


def shown_colours(cells: DataFrame, legend: dict[str, tuple[int, int, int]], include: list[str] | None = None, exclude: list[str] | None = None, alpha: float = 1.0) -> DataFrame:
    """cells (r, g, b) with alpha: 0 for black ones and for colours that the legend's chosen keys leave out."""
    keys = [k for k in legend if (include is None or k in include) and k not in (exclude or [])]
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    if include is None and not exclude:
        return cells.withColumn("alpha", F.when(black, 0.0).otherwise(alpha))
    listed = F.lit(False)
    for k in keys:
        r, g, b = legend[k]
        listed = listed | ((F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b))
    return cells.withColumn("alpha", F.when(~black & listed, alpha).otherwise(0.0))


def class_background(cells: DataFrame, classes: DataFrame, colours: DataFrame, value: str = "value", alpha: float | None = None) -> DataFrame:
    """cells with color and alpha through the class of their value (classes: value, class; colours: type, color).

    Values without a class or colour are transparent; others have the alpha given, or 1.
    """
    names = classes.select(F.col("value").alias("c_value"), F.col("class").alias("c_class")).join(colours.select(F.col("type").alias("c_class"), F.col("color").alias("c_color")), "c_class")
    out = cells.join(names, F.col(value) == F.col("c_value"), "left")
    return out.withColumns({"color": F.coalesce("c_color", F.lit("#000000")), "alpha": F.when(F.col("c_color").isNull(), 0.0).otherwise(1.0 if alpha is None else float(alpha))}).drop("c_value", "c_class", "c_color")


def background(cells: DataFrame, scheme: str, classes: DataFrame | None = None, colours: DataFrame | None = None, alpha: float | None = None) -> DataFrame:
    """cells with r, g, b in 0 to 1, or a class colour, and alpha, by colour scheme: CLASS-MAP, rgb or rgba."""
    if scheme == "CLASS-MAP":
        if classes is None or colours is None:
            raise ValueError("a class map and colours are needed")
        return class_background(cells, classes, colours, alpha=alpha)
    if scheme not in ("rgb", "rgba"):
        raise ValueError(f"no such colour scheme: {scheme}")
    bands = list(scheme)
    out = cells.withColumns(dict(zip(bands, unit_scaled([F.col(b) for b in bands]))))
    shade = F.lit(float(alpha)) if alpha is not None else F.col("a") if scheme == "rgba" else F.lit(1.0)
    return out.withColumn("alpha", shade)


def mapping_faults(mapping: DataFrame, per_year: int) -> DataFrame:
    """raster, year and n of years that have not as many bands as a colour scheme needs."""
    return mapping.select("raster", "year", F.size("bands").alias("n")).filter(F.col("n") != per_year)
