"""Monthly sums with a coverage rule, rolling sums, and the standardised drought index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_MONTHS = 30  # values of a calendar month that a fit needs
CLIP = 1e-6


def monthly_sums(daily: DataFrame, station: str, date: str, values: list[str], least: float = 0.9) -> DataFrame:
    """station, month (its first day) and the sums of values; all are null if any covers less than `least` of the days.

    Months between a station's first and last that have no day at all are there too, with nulls.
    """
    month = F.trunc(F.col(date).cast("date"), "month")
    have = daily.groupBy(station, month.alias("month")).agg(*[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"{v}_n") for v in values])
    span = have.groupBy(station).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = span.select(station, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    days = F.day(F.last_day("month"))
    enough = F.lit(True)
    for v in values:
        enough = enough & (F.coalesce(F.col(f"{v}_n"), F.lit(0)) >= least * days)
    return spine.join(have, [station, "month"], "left").select(station, "month", *[F.when(enough, F.col(v)).alias(v) for v in values])


def water_balance(months: DataFrame, precipitation: str = "precip_mm", evaporation: str = "pet_mm") -> DataFrame:
    """months with water_balance: what falls less what could evaporate; null where either is."""
    return months.withColumn("water_balance", F.col(precipitation) - F.col(evaporation))


def rolling_sum(months: DataFrame, keys: list[str], order: str, value: str, k: int, name: str) -> DataFrame:
    """months with the sum of the last k rows; null unless all k have a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - k, 0)
    return months.withColumn(name, F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def common_period(daily: DataFrame, station: str, date: str, values: list[str]) -> DataFrame:
    """daily within the days that all stations have complete, from the latest first to the earliest last one."""
    full = daily.dropna(subset=values).groupBy(station).agg(F.min(date).alias("a"), F.max(date).alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    # One row is joined to all.
    return daily.join(F.broadcast(full), (F.col(date) >= F.col("a")) & (F.col(date) <= F.col("b"))).drop("a", "b")


def generalised_logistic(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, loc, scale, shape of a generalised logistic fit by L-moments; null with too few values or no valid fit."""
    v = values.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(value)).cast("double")
    ranked = v.withColumn("i", i).withColumn("n", F.count(F.lit(1)).over(w).cast("double"))
    x, rank, n = F.col(value), F.col("i"), F.col("n")
    moments = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(x).alias("b0"), F.avg(F.try_divide(rank - 1, n - 1) * x).alias("b1"), F.avg(F.try_divide((rank - 1) * (rank - 2), (n - 1) * (n - 2)) * x).alias("b2"))
    l = moments.select(*keys, "n", F.col("b0").alias("l1"), (2 * F.col("b1") - F.col("b0")).alias("l2"), (6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")).alias("l3"))  # noqa: E741
    l = l.withColumn("t3", F.try_divide(F.col("l3"), F.col("l2")))  # noqa: E741
    fine = (F.col("n") >= LEAST_MONTHS) & (F.col("l2") > 0) & (F.abs("t3") < 1)
    k = -F.col("t3")
    near = F.abs(k) < 1e-6
    scale = F.when(near, F.col("l2")).otherwise(F.col("l2") * F.try_divide(F.sin(k * math.pi), k * math.pi))
    loc = F.when(near, F.col("l1")).otherwise(F.col("l1") - scale * (F.try_divide(F.lit(1.0), k) - F.try_divide(F.lit(math.pi), F.sin(k * math.pi))))
    return l.select(*keys, F.when(fine, loc).alias("loc"), F.when(fine, scale).alias("scale"), F.when(fine, k).alias("shape"))


def logistic_cdf(x: Column, loc: Column, scale: Column, shape: Column) -> Column:
    z = (x - loc) / scale
    inside = F.greatest(1 - shape * z, F.lit(1e-300))
    y = F.when(F.abs(shape) < 1e-6, z).otherwise(-F.log(inside) / F.when(F.abs(shape) < 1e-6, 1.0).otherwise(shape))
    return 1 / (1 + F.exp(-y))


#: Coefficients of a published rational approximation of the normal quantile (relative error below 1.2e-9), fixed values: numerator and denominator of
#: the middle, and of the tails beyond the probability 0.02425.
MIDDLE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability, which is clipped to CLIP and 1 - CLIP; null stays null."""

    def polynomial(k: tuple[float, ...], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    p = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP)))
    q = p - 0.5
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(TAIL_C, t) / polynomial(TAIL_D, t)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(q * polynomial(MIDDLE_A, q * q) / polynomial(MIDDLE_B, q * q))


def drought_index(months: DataFrame, station: str = "station", month: str = "month", value: str = "water_balance", scales: range = range(1, 13)) -> DataFrame:
    """station, month, k, total, spei: for each k the k-month sum, fitted by calendar month, as a standard normal value."""
    out = None
    for k in scales:
        one = rolling_sum(months, [station], month, value, k, "total").select(station, month, F.lit(k).alias("k"), "total")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("m", F.month(month))
    fits = generalised_logistic(out, [station, "k", "m"], "total")
    joined = out.join(fits, [station, "k", "m"], "left")
    cdf = logistic_cdf(F.col("total"), F.col("loc"), F.col("scale"), F.col("shape"))
    return joined.withColumn("cdf", F.when(F.col("total").isNotNull() & F.col("scale").isNotNull(), F.greatest(F.least(cdf, F.lit(1 - CLIP)), F.lit(CLIP)))).withColumn("spei", normal_quantile(F.col("cdf"))).select(station, month, "k", "total", "spei")


def drought_class(spei: Column) -> Column:
    return F.when(spei < -2, "extreme drought").when(spei < -1.5, "severe drought").when(spei < -1, "moderate drought").when(spei > 1.5, "severe wet").when(spei > 1, "moderate wet").when(spei.isNotNull(), "normal")


def drought_checks(index: DataFrame, station: str = "station", month: str = "month") -> DataFrame:
    """station, k, n, mean, std, min, max, the largest monthly bias, and counts of the classes."""
    bias = index.groupBy(station, "k", F.month(month).alias("m")).agg(F.avg("spei").alias("b")).groupBy(station, "k").agg(F.max(F.abs("b")).alias("seasonal_bias"))
    names = {"extreme_dry": "extreme drought", "severe_dry": "severe drought", "moderate_dry": "moderate drought", "moderate_wet": "moderate wet", "severe_wet": "severe wet"}
    named = index.withColumn("c", drought_class(F.col("spei")))
    stats = named.groupBy(station, "k").agg(F.count("spei").alias("n"), F.avg("spei").alias("mean"), F.stddev_samp("spei").alias("std"), F.min("spei").alias("min"), F.max("spei").alias("max"), *[F.count(F.when(F.col("c") == v, 1)).alias(k) for k, v in names.items()])
    return stats.join(bias, [station, "k"])
