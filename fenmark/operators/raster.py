"""Raster algebra on cells: a raster is a long table of (raster, row, col, band or value); nodata is null.

Nothing here needs a window over a whole raster: per-cell formulas are column expressions, periods and mosaics are
aggregates by (row, col), alignment is an equi-join on computed cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped

TINY = 1e-10


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1e-6); null where that is not finite."""
    out = F.try_divide(a.cast("double") - b.cast("double"), a.cast("double") + b.cast("double") + F.lit(1e-6))
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def ndvi(red: Column, nir: Column) -> Column:
    return normalised_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def ratio(vv: Column, vh: Column) -> Column:
    """vv / vh; null where |vh| is tiny."""
    return F.when(F.abs(vh) > TINY, F.try_divide(vv.cast("double"), vh.cast("double")))


def to_db(x: Column, least: float = TINY) -> Column:
    """10 log10 of positive values, at least `least`; null otherwise."""
    return F.when(x > 0, 10 * F.log10(F.greatest(x.cast("double"), F.lit(least))))


def period_stats(cells: DataFrame, keys: list[str], value: str, decimals: int | None = None) -> DataFrame:
    """keys, n, mean, median, min, max, std (sample) of the non-null values. With decimals, means of fixed-point values
    are summed exactly, so that their rounding doesn't depend on the order."""
    v = F.col(value)
    exact = v.cast(f"decimal(18,{decimals})") if decimals is not None else v
    mean = F.try_divide(F.sum(exact).cast("double"), F.count(v).cast("double")) if decimals is not None else F.avg(v)
    return cells.groupBy(*keys).agg(F.count(v).alias("n"), mean.alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"))


def quarterly(cells: DataFrame, date: str, value: str, keys: list[str]) -> DataFrame:
    """period_stats by keys, year and quarter; the deviation needs two dates."""
    return period_stats(cells.withColumns({"year": F.year(date), "quarter": F.quarter(date)}), [*keys, "year", "quarter"], value)


def monthly(cells: DataFrame, date: str, value: str, keys: list[str]) -> DataFrame:
    return period_stats(cells.withColumns({"year": F.year(date), "month": F.month(date)}), [*keys, "year", "month"], value)


def db_of_means(stats: DataFrame, a: str = "vv", b: str = "vh") -> DataFrame:
    """Decibels of two bands' mean columns, and of the ratio of the means."""
    return stats.withColumns({f"{a}_db": to_db(F.col(a)), f"{b}_db": to_db(F.col(b)), "ratio_db": to_db(ratio(F.col(a), F.col(b)))})


def mosaic_first(tiles: DataFrame, value: str, order: str, row: str = "row", col: str = "col") -> DataFrame:
    """(row, col, value): of tiles that overlap, the first by order that has a value."""
    return tiles.filter(F.col(value).isNotNull()).groupBy(row, col).agg(F.min_by(value, order).alias(value))


def to_global(tiles: DataFrame, meta: DataFrame, raster: str = "raster") -> DataFrame:
    """Cells with row and col on the common grid: meta has raster, x0, y0 (upper left corner) and res of each tile.

    The grid starts at the least x0 and the greatest y0. Tiles off the grid by more than 1e-6 cells raise an error.
    """
    edge = meta.agg(F.min("x0").alias("gx"), F.max("y0").alias("gy"), F.min("res").alias("gr"), F.max("res").alias("hr")).first()
    if edge["gx"] is None:
        return tiles
    if edge["gr"] != edge["hr"]:
        raise ValueError("tiles differ in resolution")
    dc, dr = (F.col("x0") - edge["gx"]) / edge["gr"], (F.lit(edge["gy"]) - F.col("y0")) / edge["gr"]
    shifts = meta.select(raster, dr.alias("dr"), dc.alias("dc"))
    if shifts.filter((F.abs(F.col("dr") - F.round("dr")) > 1e-6) | (F.abs(F.col("dc") - F.round("dc")) > 1e-6)).head(1):
        raise ValueError("tiles are not on one grid")
    moved = tiles.join(shifts, raster)
    return moved.withColumns({"row": F.col("row") + F.round("dr").cast("int"), "col": F.col("col") + F.round("dc").cast("int")}).drop("dr", "dc")


def stack(cells: DataFrame, bands: list[str], band: str = "band", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """One column a band for each cell that all the bands have."""
    keys = keys or ["row", "col"]
    wide = cells.filter(F.col(band).isin(bands)).groupBy(*keys).pivot(band, bands).agg(F.first(value))
    return wide.dropna(subset=bands)


def unstack(wide: DataFrame, bands: list[str], keys: list[str], raster: str | None = None) -> DataFrame:
    """keys, band, value, with band names raster_band if a raster's name is given."""
    out = wide.unpivot(keys, bands, "band", "value")
    return out.withColumn("band", F.concat(F.lit(f"{raster}_"), F.col("band"))) if raster else out


def upsampled(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor cells of the same value."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    return out.withColumns({"row": F.col("row") * factor + F.col("i"), "col": F.col("col") * factor + F.col("j")}).drop("i", "j")


def downsampled(cells: DataFrame, factor: int, value: str = "value", method: str = "average") -> DataFrame:
    """Cells of factor x factor cells: average, min, max, median, or mode (the least of equally common values)."""
    big = cells.withColumns({"row": F.floor(F.col("row") / factor).cast("int"), "col": F.floor(F.col("col") / factor).cast("int")})
    if method == "mode":
        counted = big.filter(F.col(value).isNotNull()).groupBy("row", "col", value).agg(F.count(F.lit(1)).alias("c"))
        return counted.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias(value))
    how = {"average": F.avg, "min": F.min, "max": F.max, "median": F.median}[method]
    return big.groupBy("row", "col").agg(how(value).alias(value))


def aligned(cells: DataFrame, source: tuple[float, float, float], target: tuple[float, float, float], height: int, width: int, value: str = "value", method: str = "bilinear") -> DataFrame:
    """cells resampled to a height x width grid. source and target: x0, y0 (upper left corner) and cell size.

    Bilinear weighs the four cells around a target's centre, leaving out missing ones; nearest takes the cell it lies in.
    """
    spark = cells.sparkSession
    grid = spark.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("row"), F.expr(f"cast(id % {width} as int)").alias("col"))
    (sx, sy, sr), (tx, ty, tr) = source, target
    u, v = (F.lit(tx) + (F.col("col") + 0.5) * tr - sx) / sr, (F.lit(sy) - (F.lit(ty) - (F.col("row") + 0.5) * tr)) / sr
    src = cells.select(F.col("row").cast("long").alias("s_row"), F.col("col").cast("long").alias("s_col"), F.col(value).alias("s_value"))
    if method == "nearest":
        return grid.withColumns({"s_row": F.floor(v), "s_col": F.floor(u)}).join(src, ["s_row", "s_col"]).select("row", "col", F.col("s_value").alias(value))
    placed = grid.withColumns({"fu": u - 0.5, "fv": v - 0.5})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    four = placed.withColumn("c", corner).withColumns({"s_row": F.floor("fv") + F.col("c.i"), "s_col": F.floor("fu") + F.col("c.j")})
    weight = (1 - F.abs(F.col("fv") - F.col("s_row"))) * (1 - F.abs(F.col("fu") - F.col("s_col")))
    near = four.withColumn("w", weight).filter("w > 0").join(src.filter("s_value is not null"), ["s_row", "s_col"])
    return near.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("s_value")), F.sum("w")).alias(value))


def compare_grids(meta: DataFrame, reference: str, tol: float = 0.0) -> DataFrame:
    """raster, same: whether a raster's crs, size, corner and cell size are the reference raster's, within tol."""
    ref = meta.filter(F.col("raster") == reference).limit(1).select(*[F.col(c).alias(f"r_{c}") for c in ("crs", "height", "width", "x0", "y0", "res")])
    close = lambda c: F.abs(F.col(c) - F.col(f"r_{c}")) <= tol
    # Without a known CRS nothing is known to be the same.
    same = (F.col("crs") == F.col("r_crs")) & (F.col("height") == F.col("r_height")) & (F.col("width") == F.col("r_width")) & close("x0") & close("y0") & close("res")
    # One row is joined to all.
    return meta.join(F.broadcast(ref), F.lit(True)).select("raster", F.coalesce(same, F.lit(False)).alias("same"))


def constant_like(cells: DataFrame, value: float) -> DataFrame:
    """A raster on the same cells with one value."""
    return cells.select("row", "col", F.lit(value).alias("value"))


def reclass(cls: Column, wanted: int) -> Column:
    """1 for the wanted class, else 0."""
    return (cls == wanted).cast("byte")


def masked(cells: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """cells with valid (1 inside the mask's cells, else 0) and null values outside."""
    m = mask.select("row", "col").distinct().withColumn("inside", F.lit(1))
    return cells.join(m, ["row", "col"], "left").withColumn("valid", F.coalesce("inside", F.lit(0)).cast("byte")).withColumn(value, F.when(F.col("inside") == 1, F.col(value))).drop("inside")


def stretch(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """cells with unit: values between two percentiles mapped to 0 to 1, clipped."""
    # Counts by value are the exact percentiles' input: as many rows as a band has different values.
    counted = cells.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    p = counted.agg(F.percentile("v", F.array(F.lit(low), F.lit(high)), F.col("c")).alias("p"))
    span = F.try_divide(F.col(value) - F.col("p")[0], F.col("p")[1] - F.col("p")[0])
    # One row is joined to all.
    return cells.join(F.broadcast(p), F.lit(True)).withColumn("unit", clipped(span, 0, 1)).drop("p")


def window(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of a half-open range of rows and columns; the range reaches the scan."""
    return cells.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def world_window(transform: tuple[float, float, float], box: tuple[float, float, float, float]) -> tuple[tuple[int, int], tuple[int, int]]:
    """The range of rows and columns whose cells touch a rectangle; transform: x0, y0, cell size."""
    import math

    x0, y0, res = transform
    return (math.floor((y0 - box[3]) / res), math.ceil((y0 - box[1]) / res)), (math.floor((box[0] - x0) / res), math.ceil((box[2] - x0) / res))


def band_by_description(bands: DataFrame, contains: str) -> DataFrame:
    """raster and band: the first band of each raster whose description holds a text, whatever its case; rasters without one are left out."""
    return bands.filter(F.contains(F.lower("description"), F.lit(contains.lower()))).groupBy("raster").agg(F.min("band").alias("band"))


def valid_stack(wide: DataFrame, bands: list[str], mask: str = "VALID_MASK") -> DataFrame:
    """wide with one mask: 1 where all bands have a value."""
    ok = F.lit(True)
    for b in bands:
        ok = ok & F.col(b).isNotNull()
    return wide.withColumn(mask, ok.cast("byte"))
