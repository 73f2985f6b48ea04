"""Text sources: station files with a commented header, class lists, and tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_station_days(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """station, date and the given columns (in tenths in the file) of lines `station,yyyymmdd,values...`.

    Lines that don't start with a station and a date are comments or headers. Blank values are null.
    """
    parts = F.split(F.col("value"), ",")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d+\s*,\s*\d{8}\s*(,|$)"))
    tenth = [F.try_divide(F.trim(F.get(parts, F.lit(i + 2))).try_cast("double"), F.lit(10.0)).alias(c) for i, c in enumerate(columns)]
    return rows.select(F.trim(parts[0]).cast("int").alias("station"), F.to_date(F.trim(parts[1]), "yyyyMMdd").alias("date"), *tenth)


def trace_precipitation(df: DataFrame, column: str = "precip_mm") -> DataFrame:
    """-1 tenth means less than 0.05 and becomes 0.05."""
    return df.withColumn(column, F.when(F.col(column) == -0.1, 0.05).otherwise(F.col(column)))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """value and class of a text file's list items; see class_list."""
    return class_list(spark.read.text(path))


def read_zip_text(spark: SparkSession, archive: str, member: str) -> DataFrame:
    """value: the lines of a text file in a zip archive on a path that all executors can open, by its name in whatever folder and case."""

    def lines(it):
        import io
        import zipfile

        for b in it:
            for path in b.column("path").to_pylist():
                with zipfile.ZipFile(path) as z:
                    found = [m for m in z.namelist() if m.rpartition("/")[2].lower() == member.lower()]
                    if not found:
                        raise FileNotFoundError(f"{path} lacks {member}")
                    with z.open(found[0]) as f:
                        text = io.TextIOWrapper(f, "utf-8", "replace")
                        while part := text.readlines(1 << 20):
                            yield pa.record_batch({"value": pa.array([x.rstrip("\r\n") for x in part], pa.string())})

    return spark.createDataFrame([(archive,)], "path string").mapInArrow(lines, "value string")


def class_list(lines: DataFrame) -> DataFrame:
    """value and class of list items, `- number: class`, in lines (column value): the mark goes, and the first colon parts the two.

    Other lines, and items without a whole number or a class, are left out.
    """
    rows = lines.select(F.trim("value").alias("line")).filter(F.startswith("line", F.lit("-")))
    item = F.trim(F.expr("substring(line, 2)"))
    at = F.instr(item, ":")
    parts = rows.select(F.when(at > 0, F.trim(F.substring(item, F.lit(1), at - 1))).try_cast("int").alias("value"), F.trim(F.substring(item, at + 1, F.length(item))).alias("class"))
    return parts.filter("value is not null and class <> ''")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def period_path(base: str, year: int, period: str) -> str:
    """The folder of a partition: period is Q1 to Q4 or 01 to 12."""
    if period not in {"Q1", "Q2", "Q3", "Q4", *(f"{m:02d}" for m in range(1, 13))}:
        raise ValueError(f"no such period: {period}")
    return f"{base}/year={year}/timeframe={period}"


def write_periods(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by year and timeframe, so that readers of a period skip the others."""
    df.write.mode(mode).partitionBy("year", "timeframe").parquet(path)
