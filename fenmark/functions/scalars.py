"""Column functions: labels, names, years, colours, dates and affine arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------ text


def clean_label(c: Column, fold: bool = True) -> Column:
    """Trimmed, without a trailing .0, lower-cased if fold; null stays null."""
    out = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.lower(out) if fold else out


def column_suffix(c: Column) -> Column:
    """Spaces and slashes become underscores."""
    return F.regexp_replace(c.cast("string"), r"[ /\\]", "_")


def bare_name(c: Column) -> Column:
    """Lower-cased, trimmed, without underscores and spaces; null becomes empty."""
    return F.coalesce(F.lower(F.regexp_replace(F.trim(c.cast("string")), "[_ ]", "")), F.lit(""))


def prefixed_id(prefix: str, c: Column) -> Column:
    """An id behind a prefix; null stays null."""
    return F.concat(F.lit(prefix), c.cast("string"))


def polygon_key(c: Column) -> Column:
    """An id without its trailing number."""
    return F.regexp_replace(c, r"_[0-9]+$", "")


def first_tokens(c: Column, n: int = 2, sep: str = "_") -> Column:
    """The first n tokens of an id."""
    return F.substring_index(c, sep, n)


def run_division(run_id: Column) -> Column:
    """The first token of a run's name."""
    return F.substring_index(run_id, "_", 1)


def run_attempt(run_id: Column) -> Column:
    """The token at<number>; null if there is none."""
    found = F.regexp_extract(run_id, r"(?:^|_)(at\d+)(?:_|$)", 1)
    return F.when(found != "", found)


def first_known_token(name: Column, known: list[str], sep: str = "__") -> Column:
    """The first sep-separated token that is in known; null if none is."""
    return F.element_at(F.array_append(F.filter(F.split(name, sep), lambda t: t.isin(known)), F.lit(None).cast("string")), 1)


def insert_after_tmp(name: Column, token: str) -> Column:
    """name with a token behind its first tmp<number> token."""
    return F.regexp_replace(name, r"^(.*?_tmp\d+)", f"$1_{token}")


def epsg_code(c: Column) -> Column:
    """EPSG:<number> from UTM32631, RD, WGS84, a number or EPSG:<number>; null if it is none of them."""
    s = F.upper(F.trim(c.cast("string")))
    digits = F.regexp_extract(s, r"^(?:EPSG:|UTM)?(\d{4,5})$", 1)
    return F.when(s == "RD", "EPSG:28992").when(s == "WGS84", "EPSG:4326").when(digits != "", F.concat(F.lit("EPSG:"), digits))


def list_cell(c: Column) -> Column:
    """A text such as `[a, 'b']`, or one id, as a list of ids; null and empty as an empty list."""
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.expr("cast(array() as array<string>)"))


# ------------------------------------------------------------------ years


def year_list(c: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty parts of a text of years."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def expand_years(c: Column) -> Column:
    """As year_list, where `a, ..., b` stands for all years from the one before the dots to the one after."""
    parts = year_list(c)

    def grown(x: Column, i: Column) -> Column:
        before, after = F.get(parts, i - 1).cast("int"), F.get(parts, i + 1).cast("int")
        span = F.transform(F.sequence(before, after), lambda y: y.cast("string"))
        return F.when((x == "...") & (before <= after), span).when(x == "...", F.expr("cast(array() as array<string>)")).otherwise(F.array(x))

    return F.array_distinct(F.flatten(F.transform(parts, grown)))


def has_year(c: Column, year: int) -> Column:
    """Whether a text holds the year, not as part of a longer number."""
    return c.rlike(rf"(?<!\d){year}(?!\d)")


def years_csv(years: Column) -> Column:
    """Sorted distinct years as text without spaces."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(years, lambda y: F.trim(y.cast("string"))))), ",")


def normal_year(c: Column) -> Column:
    """A number where the text is one, else null."""
    return c.cast("string").try_cast("int")


def year_order(c: Column) -> list[Column]:
    """Sort keys: numbers by value, then other texts."""
    n = c.try_cast("int")
    return [F.when(n.isNull(), 1).otherwise(0), n, c]


def year_quarter(c: Column, pattern: str = "yyyy-MM-dd") -> tuple[Column, Column]:
    """Year and quarter of a date given as text."""
    d = F.to_date(c, pattern)
    return F.year(d), F.quarter(d)


def fractional_year(year: Column, position: Column, periods: int) -> Column:
    """The middle of period number position (from 0) of a year of so many periods."""
    return year + (position + F.lit(0.5)) / F.lit(periods)


# ------------------------------------------------------------------ numbers


def clipped(c: Column, low: float, high: float) -> Column:
    """c within two bounds; null stays null (greatest and least would pass over it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c.cast("double"), F.lit(float(high))), F.lit(float(low))))


def round2(c: Column) -> Column:
    """Two decimals, half to even; null stays null."""
    return F.bround(c, 2)


def to_int16(c: Column) -> Column:
    """Clamped to the 16-bit range, then cut to a whole number."""
    return clipped(c, -32768, 32767).cast("short")


def row_col(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Row and column of a point, from the affine transform (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    dx, dy = x - F.lit(c), y - F.lit(f)
    return F.floor((dy * F.lit(a) - dx * F.lit(d)) / F.lit(det)), F.floor((dx * F.lit(e) - dy * F.lit(b)) / F.lit(det))


# ------------------------------------------------------------------ colours


def hex_rgb(c: Column) -> Column:
    """Red, green and blue in 0 to 1 of #rrggbb or #rrggbbaa, with or without the #."""
    h = F.regexp_replace(c, "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def rgb_hex(*parts: Column) -> Column:
    """# and two hexadecimal digits for each part in 0 to 1."""
    digits = [F.lpad(F.lower(F.hex(F.bround(clipped(p, 0, 1) * 255, 0).cast("long"))), 2, "0") for p in parts]
    return F.concat(F.lit("#"), *digits)


def rgb_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees (0 of a grey), saturation and value in 0 to 1.

    The hue is the angle on the hexagon of colours, measured from the sector of the channel that is greatest (of equal ones the
    first): 60 degrees a sector, red at 0, green at 120, blue at 240.
    """
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    part = lambda d: F.coalesce(F.try_divide(d, top - low), F.lit(0.0))
    sectors = F.array(F.struct(r.alias("c"), part(g - b).alias("d")), F.struct(g.alias("c"), part(b - r).alias("d")), F.struct(b.alias("c"), part(r - g).alias("d")))
    first = F.array_position(F.transform(sectors, lambda s: s["c"]), top) - 1
    hue = F.pmod(120 * first + 60 * F.get(sectors, first.cast("int"))["d"], F.lit(360.0))
    return F.struct(hue.alias("h"), F.coalesce(F.try_divide(top - low, top), F.lit(0.0)).alias("s"), top.alias("v"))


def hsv_rgb(h: Column, s: Column, v: Column) -> Column:
    """Red, green and blue of a hue in degrees: channel n is v - v s max(0, min(k, 4 - k, 1)) with k = (n + h / 60) mod 6."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def pair_number(a: Column, b: Column, size: int) -> Column:
    """A number below size from a digest of two values in either order."""
    pair = F.concat_ws("_", F.array_sort(F.array(a.cast("string"), b.cast("string"))))
    return F.pmod(F.conv(F.substring(F.md5(pair), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def unit_scaled(parts: list[Column]) -> list[Column]:
    """Divided by 255 if any part is above 1, then clipped to 0 to 1."""
    large = reduce(lambda x, y: x | y, [p > 1 for p in parts])
    return [clipped(F.when(large, p / 255).otherwise(p), 0, 1) for p in parts]
