"""Index tables: which ids a class has in each year, kept long as (class, year, ids or id); wide only on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import year_list

EARLY, EARLY_LABEL = (2010, 2016), "2010-2016"
SELECTED_YEARS = list(range(2017, 2025))


def entries(rows: DataFrame, cls: str, years: str, id_col: str, sep: str = ",") -> DataFrame:
    """(class, year, id): one row for each year in a row's text of years; rows without a class or years give none."""
    return rows.filter(F.col(cls).isNotNull()).select(F.col(cls).alias("class"), F.col(id_col).alias("id"), F.explode(year_list(F.col(years), sep)).alias("year")).select("class", "year", "id")


def all_years(rows: DataFrame, cls: str, years: str, id_col: str) -> DataFrame:
    """Entries of every year, numeric or not."""
    return entries(rows, cls, years, id_col)


def early_bucket(rows: DataFrame, cls: str, years: str, id_col: str) -> DataFrame:
    """Years of the early period share one label; later years stay, earlier ones and other texts go. Ids may repeat."""
    n = F.col("year").try_cast("int")
    label = F.when(n.between(*EARLY), EARLY_LABEL).when(n > EARLY[1], F.col("year"))
    return entries(rows, cls, years, id_col).withColumn("year", label).filter("year is not null")


def selected_years(rows: DataFrame, cls: str, years: str, id_col: str, wanted: list[int] | None = None) -> DataFrame:
    """Entries of the wanted years only (2017 to 2024 by default); texts that are no number go."""
    n = F.col("year").try_cast("int")
    return entries(rows, cls, years, id_col).filter(n.isin(wanted or SELECTED_YEARS)).withColumn("year", n.cast("string"))


def as_lists(index: DataFrame) -> DataFrame:
    """(class, year, ids), ids in order."""
    return index.groupBy("class", "year").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def wide(index: DataFrame, years: list[str]) -> DataFrame:
    """One list column a year; years without ids are empty lists."""
    out = index.groupBy("class").pivot("year", years).agg(F.array_sort(F.collect_list("id")))
    return out.select("class", *[F.coalesce(F.col(f"`{y}`"), F.expr("cast(array() as array<string>)")).alias(y) for y in years])


def known_codes(index: DataFrame, rows: DataFrame, reference: DataFrame, id_col: str, code: str) -> DataFrame:
    """Entries whose id is in rows with a code that the reference table has; classes left without any vanish."""
    fine = rows.join(reference.select(F.col(code).alias("ref_code")).distinct(), F.col(code) == F.col("ref_code"), "left_semi").select(F.col(id_col).alias("ok_id")).distinct()
    return index.join(fine, index["id"] == F.col("ok_id"), "left_semi")


def full_cover(index: DataFrame, rows: DataFrame, id_col: str, pct: str, least: float = 100) -> DataFrame:
    """(class, year, id) of ids whose cover is at least so much; classes left without any stay, with null year and id."""
    fine = rows.filter(F.col(pct) >= least).select(F.col(id_col).alias("ok_id")).distinct()
    kept = index.join(fine, index["id"] == F.col("ok_id"), "left_semi")
    return index.select(F.col("class").alias("class_")).distinct().join(kept, F.col("class_") == F.col("class"), "left").select(F.col("class_").alias("class"), "year", "id")


def regrouped(index: DataFrame, rows: DataFrame, lookup: DataFrame, id_col: str, code: str, division: str) -> DataFrame:
    """(class, year, id) with the division of an id's code as class: distinct ids; codes without a division are left out."""
    table = lookup.select(F.col(code).alias("l_code"), F.col(division).alias("class")).filter("class is not null").distinct()
    codes = rows.select(F.col(id_col).alias("r_id"), F.col(code).alias("r_code")).distinct()
    return index.select("year", "id").join(codes, F.col("id") == F.col("r_id")).join(table, F.col("r_code") == F.col("l_code")).select("class", "year", "id").distinct()


def pixel_count(index: DataFrame, rows: DataFrame, id_col: str, area: str, cell: float = 100) -> DataFrame:
    """(class, year, pixels): each id's area in cells, cut to a whole number before the sum; repeated ids count again."""
    areas = rows.select(F.col(id_col).alias("a_id"), F.floor(F.col(area) / cell).cast("long").alias("cells"))
    return index.join(areas, index["id"] == F.col("a_id")).groupBy("class", "year").agg(F.coalesce(F.sum("cells"), F.lit(0)).cast("long").alias("pixels"))


def unique_area(index: DataFrame, rows: DataFrame, id_col: str, area: str, cell: float = 100) -> DataFrame:
    """(class, n_ids, area): over each class's distinct ids, the area in cells, not cut."""
    areas = rows.select(F.col(id_col).alias("a_id"), F.col(area).alias("a_area"))
    distinct = index.select("class", "id").distinct()
    return distinct.join(areas, F.col("id") == F.col("a_id")).groupBy("class").agg(F.count(F.lit(1)).alias("n_ids"), (F.sum("a_area") / cell).alias("area"))


def to_rows(index: DataFrame, rows: DataFrame | None = None, id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
    """(type, id, years): the sorted years of each class's id, joined by commas, with columns of rows if they are given."""
    out = index.groupBy(F.col("class").alias("type"), "id").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))
    if rows is None:
        return out
    return out.join(rows.select(F.col(id_col).alias("s_id"), *(keep or [])), F.col("id") == F.col("s_id")).drop("s_id")


def missing_ids(index: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Ids of the index that rows don't have."""
    return index.select("id").distinct().join(rows.select(F.col(id_col).alias("s_id")), F.col("id") == F.col("s_id"), "left_anti")


def split_marks(counts: DataFrame, original: DataFrame) -> DataFrame:
    """(class, year, shown): a split's count, or [-] where the original has ids and the split none."""
    a, b = counts.select("class", "year", "pixels"), original.groupBy("class", "year").agg(F.count(F.lit(1)).alias("had"))
    both = a.join(b, ["class", "year"], "full")
    gone = (F.coalesce("pixels", F.lit(0)) == 0) & (F.coalesce("had", F.lit(0)) > 0)
    return both.select("class", "year", F.when(gone, "[-]").when(F.col("pixels") == 0, "").when(F.col("pixels") > 999, "999+").otherwise(F.col("pixels").cast("string")).alias("shown"))


def with_default(rows: DataFrame, lookup: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """rows with the looked-up name, or the default for unknown keys."""
    table = lookup.select(F.col(key).alias("l_key"), F.col(name).alias("l_name"))
    return rows.join(table, F.col(key) == F.col("l_key"), "left").withColumn(name, F.coalesce("l_name", F.lit(default))).drop("l_key", "l_name")


def tidy(rows: DataFrame, order: list[str | Column], prefix: str, constants: dict[str, object], area: str, least: float | None = None) -> DataFrame:
    """rows of at least some area with constant columns and ids prefix_1, prefix_2, ... in the order given."""
    from .numbering import numbered

    kept = rows.filter(F.col(area) >= least) if least is not None else rows
    return numbered(kept, order, "n").withColumns({k: F.lit(v) for k, v in constants.items()}).withColumn("index", F.concat(F.lit(f"{prefix}_"), F.col("n").cast("string"))).drop("n")


def cleaned_areas(rows: DataFrame, area: str, pct: str, drop: list[str] | None = None) -> DataFrame:
    """rows without some columns, with area (a whole number, half to even) and covered, its part by a text of percent (null where that is no number)."""
    share = F.col(area) * F.col(pct).try_cast("double") / 100
    return rows.drop(*(drop or [])).withColumns({"covered": F.bround(share, 0).cast("long"), "area": F.bround(F.col(area), 0).cast("long")})


def union_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, which must have the same columns in the same order."""
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    return a.union(b)


def golden_check(found: DataFrame, expected: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """keys, expected, found of counts that differ or are missing on either side."""
    f, e = found.select(*keys, F.col(value).alias("found")), expected.select(*keys, F.col(value).alias("expected"))
    return f.join(e, keys, "full").filter(~F.col("found").eqNullSafe(F.col("expected"))).select(*keys, "expected", "found")
