"""Polygons as well-known binary: measures, predicates, clipping by rectangles, and reprojection.

Geometry columns stay binary; pandas UDFs work on batches. Joins go through cells of a coarse grid first, so that no
pair of far features is ever compared. They are merge joins: Spark guesses sizes from the tables' files, not from the cells
made of them, and would broadcast millions of rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Ring = np.ndarray  # points, the last equal to the first
Polygon = list[Ring]  # the outer ring, then holes

# ------------------------------------------------------------------ well-known binary


def dump_wkb(polygons: list[Polygon]) -> bytes:
    def one(p: Polygon) -> bytes:
        return struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in p)

    return one(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def dump_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def load_wkb(raw: bytes) -> list[Polygon]:
    """The polygons of a geometry: those of a polygon, multipolygon or collection; a point is a ring of one point."""
    out: list[Polygon] = []

    def walk(at: int) -> int:
        end = "<" if raw[at] else ">"
        kind = struct.unpack_from(f"{end}I", raw, at + 1)[0]
        dims = 2 + ((kind // 1000) % 4 in (1, 2)) + 2 * (kind // 1000 == 3) + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        if kind & 0x20000000:
            at += 4
        kind = (kind & 0xFFFF) % 1000
        at += 5
        if kind == 1:
            out.append([np.frombuffer(raw, f"{end}f8", dims, at)[:2].reshape(1, 2)])
            return at + 8 * dims
        n = struct.unpack_from(f"{end}I", raw, at)[0]
        at += 4
        if kind == 2:
            return at + 8 * dims * n
        if kind == 3:
            rings = []
            for _ in range(n):
                k = struct.unpack_from(f"{end}I", raw, at)[0]
                rings.append(np.frombuffer(raw, f"{end}f8", k * dims, at + 4).reshape(k, dims)[:, :2])
                at += 4 + 8 * dims * k
            if rings:
                out.append(rings)
            return at
        for _ in range(n):
            at = walk(at)
        return at

    walk(0)
    return out


# ------------------------------------------------------------------ measures


def _ring_area(r: Ring) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return 0.5 * float(x[:-1] @ y[1:] - x[1:] @ y[:-1]) if len(r) > 2 else 0.0


def area_of(polygons: list[Polygon]) -> float:
    return sum(abs(_ring_area(p[0])) - sum(abs(_ring_area(h)) for h in p[1:]) for p in polygons)


def centroid_of(polygons: list[Polygon]) -> tuple[float, float]:
    """The centre of area; of points the mean."""
    sx = sy = total = 0.0
    for p in polygons:
        for i, r in enumerate(p):
            o = r[0]
            x, y = (r - o).T
            cross = x[:-1] * y[1:] - x[1:] * y[:-1]
            a = cross.sum() / 2
            if a:
                w = abs(a) * (1 if i == 0 else -1)
                sx += w * (o[0] + ((x[:-1] + x[1:]) * cross).sum() / (6 * a))
                sy += w * (o[1] + ((y[:-1] + y[1:]) * cross).sum() / (6 * a))
                total += w
    if total:
        return sx / total, sy / total
    points = np.concatenate([p[0] for p in polygons])
    return tuple(points.mean(axis=0))


def bounds_of(polygons: list[Polygon]) -> tuple[float, float, float, float]:
    points = np.concatenate([p[0] for p in polygons])
    return (*points.min(axis=0), *points.max(axis=0))


def holds(polygons: list[Polygon], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie inside, by the parity of crossings of a ray to the right."""
    out = np.zeros(len(x), bool)
    for p in polygons:
        inside = np.zeros(len(x), bool)
        for r in p:
            for (x0, y0), (x1, y1) in zip(r[:-1], r[1:]):
                if y0 != y1:
                    inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out |= inside
    return out


# ------------------------------------------------------------------ clipping


def _half_plane(r: np.ndarray, axis: int, bound: float, keep_above: bool) -> np.ndarray:
    """A ring cut by a line parallel to an axis."""
    if len(r) < 2:
        return r[:0]
    side = (r[:, axis] - bound) * (1 if keep_above else -1)
    out = []
    for i in range(len(r) - 1):
        a, b, sa, sb = r[i], r[i + 1], side[i], side[i + 1]
        if sa >= 0:
            out.append(a)
        if (sa > 0 > sb) or (sa < 0 < sb):
            cut = a + (b - a) * (sa / (sa - sb))
            cut[axis] = bound  # exactly, so that parts on both sides of a line fit together
            out.append(cut)
    return np.array([*out, out[0]]) if out else r[:0]


def clip_box(polygons: list[Polygon], box: tuple[float, float, float, float]) -> list[Polygon]:
    """The parts inside a rectangle."""
    out = []
    for p in polygons:
        rings = []
        for r in p:
            for axis, bound, above in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
                r = _half_plane(r, axis, bound, above)
            if len(r) > 3 and abs(_ring_area(r)) > 0:
                rings.append(r)
            elif not rings:
                break
        if rings:
            out.append(rings)
    return out


def _cut_all(at: np.ndarray, ring: np.ndarray, axis: int, bounds: np.ndarray, keep_above: bool) -> tuple[np.ndarray, np.ndarray]:
    """_half_plane of many rings, each without its last point, at its own bound: (points, their rings' numbers, in order)."""
    if not len(ring):
        return at, ring
    after = _after(ring)
    bound = bounds[ring]
    side = (at[:, axis] - bound) * (1 if keep_above else -1)
    other = side[after]
    stays, crosses = side >= 0, ((side > 0) & (other < 0)) | ((side < 0) & (other > 0))
    n = stays.astype(np.int64) + crosses
    place = np.cumsum(n) - n
    out = np.empty((int(n.sum()), 2))
    out[place[stays]] = at[stays]
    a, b, sa, sb = at[crosses], at[after][crosses], side[crosses], other[crosses]
    cut = a + (b - a) * (sa / (sa - sb))[:, None]
    cut[:, axis] = bound[crosses]  # exactly, so that parts on both sides of a line fit together
    out[(place + stays)[crosses]] = cut
    return out, np.repeat(ring, n)


def _after(ring: np.ndarray) -> np.ndarray:
    """The place of each point's successor in its ring."""
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    after = np.arange(1, len(ring) + 1)
    after[np.r_[first[1:], len(ring)] - 1] = first
    return after


def _cut_rings(raws: list[bytes], boxes: np.ndarray) -> tuple[list[list[Polygon]], np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """What clip_boxes leaves, before it is put together: parts of the rows whose rings aren't closed, areas, points, and for each ring
    that is left its row, whether it is the first of a polygon, and where its points begin and end. Equal geometries are read once."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(raw, len(known)) for raw in raws], np.int64)
    shapes = [load_wkb(raw) for raw in known]
    out: list[list[Polygon]] = [[] for _ in raws]
    area = np.zeros(len(raws))
    odd = np.array([any(len(r) > 1 and not np.array_equal(r[0], r[-1]) for p in g for r in p) for g in shapes], bool)
    for i in np.flatnonzero(odd[which]) if len(raws) else []:  # rings that aren't closed
        out[i] = clip_box(shapes[which[i]], tuple(boxes[i]))
        area[i] = area_of(out[i])
    # The rings of all rows, one after another: their row, and whether they are the first of a polygon.
    rings = [[(r[:-1], j == 0) for p in g for j, r in enumerate(p)] if not o else [] for g, o in zip(shapes, odd)]
    points = [np.concatenate([r for r, _ in g]) if g else np.zeros((0, 2)) for g in rings]
    counts, sizes = np.array([len(g) for g in rings], np.int64), np.array([len(g) for g in points], np.int64)
    none = np.zeros(0, np.int64)
    if not len(raws) or not sizes.sum():
        return out, area, np.zeros((0, 2)), (none, none.astype(bool), none, none)
    spread = lambda begin, n: np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = spread((np.cumsum(counts) - counts)[which], counts[which])  # each ring's place among those of the different shapes
    row = np.repeat(np.arange(len(raws)), counts[which])
    outer = np.array([o for g in rings for _, o in g], bool)[own]
    ring = np.repeat(np.arange(len(own)), np.array([len(r) for g in rings for r, _ in g], np.int64)[own])
    at = np.concatenate(points)[spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
    for axis, k, above in ((0, 0, True), (1, 1, True), (0, 2, False), (1, 3, False)):
        at, ring = _cut_all(at, ring, axis, boxes[row, k], above)
    if not len(ring):
        return out, area, at, (none, none.astype(bool), none, none)
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    ends = np.r_[first[1:], len(ring)]
    after = _after(ring)
    d = at - np.repeat(at[first], ends - first, axis=0)
    left = np.zeros(len(own))
    left[ring[first]] = np.abs(0.5 * (np.add.reduceat(d[:, 0] * d[after, 1], first) - np.add.reduceat(d[after, 0] * d[:, 1], first)))
    begin, end = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    begin[ring[first]], end[ring[first]] = first, ends
    good = (end - begin > 2) & (left > 0)
    home = np.maximum.accumulate(np.where(outer, np.arange(len(own)), 0))  # the first ring of each one's polygon
    good &= good[home]
    area += np.bincount(row[good], np.where(outer, left, -left)[good], len(raws))
    return out, area, at, (row[good], outer[good], begin[good], end[good])


def _put_together(out: list[list[Polygon]], at: np.ndarray, rings: tuple[np.ndarray, ...]) -> None:
    """Adds rings, closed, to their rows."""
    for i, is_first, a, b in zip(*[x.tolist() for x in rings]):
        r = np.concatenate([at[a:b], at[a : a + 1]])
        if is_first:
            out[i].append([r])
        else:
            out[i][-1].append(r)


def clip_boxes(raws: list[bytes], boxes: np.ndarray) -> tuple[list[list[Polygon]], np.ndarray]:
    """clip_box of each geometry with its own rectangle (x0, y0, x1, y1), and the areas that are left."""
    out, area, at, rings = _cut_rings(raws, boxes)
    _put_together(out, at, rings)
    return out, area


def clip_boxes_wkb(raws: list[bytes], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dump_wkb of what clip_boxes leaves of each geometry (null: nothing), and the areas. Rows with one ring are written many at a time."""
    out, area, at, rings = _cut_rings(raws, boxes)
    row, _, begin, end = rings
    alone = np.bincount(row, minlength=len(raws))[row] == 1
    _put_together(out, at, tuple(x[~alone] for x in rings))
    found = np.empty(len(raws), object)
    for i in [i for i, p in enumerate(out) if p]:
        found[i] = dump_wkb(out[i])
    size = end - begin
    for n in np.unique(size[alone]).tolist():
        of = alone & (size == n)
        head = np.frombuffer(struct.pack("<BIII", 1, 3, 1, n + 1), np.uint8)
        points = at[begin[of][:, None] + np.r_[0:n, 0]].astype("<f8", copy=False).reshape(-1, 2 * n + 2).view(np.uint8)
        raw = np.concatenate([np.broadcast_to(head, (len(points), len(head))), points], axis=1).tobytes()
        k = len(head) + points.shape[1]
        found[row[of]] = [raw[i : i + k] for i in range(0, len(raw), k)]
    return found, area


def box_polygon(x0: float, y0: float, x1: float, y1: float) -> list[Polygon]:
    return [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]])]]


# ------------------------------------------------------------------ reprojection

#: Dutch national grid from and to geographic coordinates: published polynomial coefficients (p, q, value), in seconds
#: of arc, fixed values. Accuracy is about a decimetre inside the Netherlands.
RD_X0, RD_Y0, PHI0, LAM0 = 155000.0, 463000.0, 52.15517440, 5.38720621
RD_PHI = [(0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012)]
RD_LAM = [(1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026)]
RD_X = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
RD_Y = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]


def rd_to_geographic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = (x - RD_X0) * 1e-5, (y - RD_Y0) * 1e-5
    total = lambda t: sum(k * dx**p * dy**q for p, q, k in t)
    return LAM0 + total(RD_LAM) / 3600, PHI0 + total(RD_PHI) / 3600


def geographic_to_rd(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = 0.36 * (lat - PHI0), 0.36 * (lon - LAM0)
    total = lambda t: sum(k * a**p * b**q for p, q, k in t)
    return RD_X0 + total(RD_X), RD_Y0 + total(RD_Y)


#: Ellipsoid and transverse Mercator constants, fixed values.
AXIS, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_UP = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_DOWN = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LAT = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def geographic_to_utm(lon: np.ndarray, lat: np.ndarray, zone: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """By the series in the third flattening to its third power: a millimetre within a zone's width."""
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone - 183))
    k = 2 * np.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    e = FALSE_EASTING + SCALE * _A * (eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_UP, 1)))
    n = SCALE * _A * (xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_UP, 1)))
    return e, n


def utm_to_geographic(e: np.ndarray, n: np.ndarray, zone: int = 31) -> tuple[np.ndarray, np.ndarray]:
    xi, eta = n / (SCALE * _A), (e - FALSE_EASTING) / (SCALE * _A)
    x = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_DOWN, 1))
    h = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_DOWN, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(h))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_LAT, 1))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(h), np.cos(x))), np.degrees(phi)


_TO = {4326: lambda x, y: (x, y), 28992: rd_to_geographic, 32631: utm_to_geographic}
_FROM = {4326: lambda x, y: (x, y), 28992: geographic_to_rd, 32631: geographic_to_utm}


def reproject_points(x: np.ndarray, y: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    if source == target:
        return x, y
    return _FROM[target](*_TO[source](np.asarray(x, float), np.asarray(y, float)))


# ------------------------------------------------------------------ columns


def _each(kind: str, f):
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(load_wkb(bytes(v))) for v in s], dtype=object)

    return F.pandas_udf(run, kind)


def st_area(c: Column) -> Column:
    return _each("double", lambda g: float(area_of(g)))(c)


def st_centroid(c: Column) -> Column:
    return _each("array<double>", lambda g: [float(v) for v in centroid_of(g)])(c)


def st_bounds(c: Column) -> Column:
    return _each("array<double>", lambda g: [float(v) for v in bounds_of(g)])(c)


def st_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle of four bounds."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        head = np.frombuffer(struct.pack("<BIII", 1, 3, 1, 5), np.uint8)
        points = np.column_stack([a, b, c, b, c, d, a, d, a, b]).astype("<f8").view(np.uint8)
        raw = np.concatenate([np.broadcast_to(head, (len(a), len(head))), points], axis=1).tobytes()
        n = len(head) + 80
        return pd.Series([raw[i : i + n] for i in range(0, len(raw), n)], dtype=object)

    return F.pandas_udf(run, "binary")(*[v.cast("double") for v in (x0, y0, x1, y1)])


def st_polygons(c: Column) -> Column:
    """Only the polygonal parts, always as a multipolygon; null where there is none."""

    def keep(g: list[Polygon]) -> bytes | None:
        parts = [p for p in g if len(p[0]) > 3]
        return struct.pack("<BII", 1, 6, len(parts)) + b"".join(dump_wkb([p]) for p in parts) if parts else None

    return _each("binary", keep)(c)


def st_reproject(c: Column, source: int, target: int) -> Column:
    return _each("binary", lambda g: dump_wkb([[np.column_stack(reproject_points(r[:, 0], r[:, 1], source, target)) for r in p] for p in g]))(c)


def cells_of(features: DataFrame, geometry: str, size: float) -> DataFrame:
    """features with bounds and one row for each grid cell that their bounds touch."""
    b = features.filter(F.col(geometry).isNotNull()).withColumn("bounds", st_bounds(F.col(geometry)))
    span = lambda i, j: F.sequence(F.floor(F.col("bounds")[i] / size).cast("int"), F.floor(F.col("bounds")[j] / size).cast("int"))
    return b.withColumn("cell_x", F.explode(span(0, 2))).withColumn("cell_y", F.explode(span(1, 3)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, geometry: str = "geometry", x: str = "x", y: str = "y", size: float = 1000.0) -> DataFrame:
    """points and the polygons that hold them, met in grid cells and then tested exactly.

    Each different place is tested once against each different geometry; the rows that have them are joined to the pairs. No side is
    broadcast: from the sizes of the tables Spark can't guess how many cells or pairs are made of them.
    """

    def inside(g: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
        out = np.zeros(len(g), bool)
        for raw, at in g.groupby(g).groups.items():
            i = g.index.get_indexer(at)
            out[i] = holds(load_wkb(bytes(raw)), px.to_numpy()[i], py.to_numpy()[i])
        return pd.Series(out)

    spots = points.select(F.col(x).alias("pp_x"), F.col(y).alias("pp_y")).distinct()
    placed = spots.withColumns({"cell_x": F.floor(F.col("pp_x") / size).cast("int"), "cell_y": F.floor(F.col("pp_y") / size).cast("int")})
    shapes = polygons.select(F.col(geometry).alias("pp_shape")).distinct()
    met = placed.hint("merge").join(cells_of(shapes, "pp_shape", size), ["cell_x", "cell_y"])
    near = (F.col("pp_x") >= F.col("bounds")[0]) & (F.col("pp_x") <= F.col("bounds")[2]) & (F.col("pp_y") >= F.col("bounds")[1]) & (F.col("pp_y") <= F.col("bounds")[3])
    pairs = met.filter(near).filter(F.pandas_udf(inside, "boolean")("pp_shape", "pp_x", "pp_y")).select("pp_shape", "pp_x", "pp_y")
    held = pairs.hint("merge").join(polygons.withColumn("pp_geometry", F.col(geometry)), F.col("pp_shape") == F.col("pp_geometry")).drop("pp_shape", "pp_geometry")
    at = points.withColumns({"pp_px": F.col(x), "pp_py": F.col(y)})
    out = at.hint("merge").join(held, (F.col("pp_px") == F.col("pp_x")) & (F.col("pp_py") == F.col("pp_y")))
    return out.drop("pp_px", "pp_py", "pp_x", "pp_y")


def cut_to_cells(features: DataFrame, geometry: str, size: float, whole: bool = False) -> DataFrame:
    """features cut to the grid cells they touch, with row, col (from the origin), geometry and area; or only whole cells.

    Features are dealt out anew first: a short file is one task's, but each of its features may touch many cells.
    """

    def cut(g: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.DataFrame:
        i, j = cx.to_numpy(np.int64), cy.to_numpy(np.int64)
        parts, area = clip_boxes_wkb([bytes(raw) for raw in g], np.column_stack([i * size, j * size, (i + 1) * size, (j + 1) * size]))
        parts[~(area >= size * size * (1 - 1e-9) if whole else area > 0)] = None
        return pd.DataFrame({"geometry": pd.Series(parts, dtype=object), "area": area})

    dealt = features.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Otherwise the filter would run the cut a second time.
    part = F.pandas_udf(cut, "geometry binary, area double").asNondeterministic()(geometry, "cell_x", "cell_y")
    # Cells that begin where a feature ends hold no area of it.
    inside = (F.col("cell_x") * F.lit(float(size)) < F.col("bounds")[2]) & (F.col("cell_y") * F.lit(float(size)) < F.col("bounds")[3])
    parts = cells_of(dealt, geometry, size).filter(inside).withColumn("cc_part", part).filter("cc_part.geometry is not null")
    out = parts.withColumns({geometry: F.col("cc_part.geometry"), "area": F.col("cc_part.area")})
    return out.withColumnsRenamed({"cell_x": "col", "cell_y": "row"}).drop("bounds", "cc_part")


def clip_features(features: DataFrame, geometry: str, box: tuple[float, float, float, float]) -> DataFrame:
    """features cut to a rectangle; those outside go."""

    def cut(g: pd.Series) -> pd.Series:
        parts = [None if raw is None else clip_box(load_wkb(bytes(raw)), box) for raw in g]
        return pd.Series([dump_wkb(p) if p else None for p in parts], dtype=object)

    return features.withColumn(geometry, F.pandas_udf(cut, "binary")(geometry)).filter(F.col(geometry).isNotNull())


def meeting(left: DataFrame, right: DataFrame, geometry: str, other: str, size: float = 1000.0) -> DataFrame:
    """The pairs of rows whose geometries share some area, met in grid cells; a pair counts in the cell of its common lower left corner alone."""
    a = cells_of(left, geometry, size).withColumnRenamed("bounds", "l_bounds")
    b = cells_of(right, other, size).withColumnRenamed("bounds", "r_bounds")
    l, r = F.col("l_bounds"), F.col("r_bounds")  # noqa: E741
    near = (l[0] < r[2]) & (l[2] > r[0]) & (l[1] < r[3]) & (l[3] > r[1])
    first = (F.col("cell_x") == F.floor(F.greatest(l[0], r[0]) / size).cast("int")) & (F.col("cell_y") == F.floor(F.greatest(l[1], r[1]) / size).cast("int"))

    def share(g: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([bool(intersection(load_wkb(bytes(x)), load_wkb(bytes(y)))) for x, y in zip(g, o)])

    pairs = a.hint("merge").join(b, ["cell_x", "cell_y"]).filter(near & first)
    return pairs.filter(F.pandas_udf(share, "boolean")(geometry, other)).drop("cell_x", "cell_y", "l_bounds", "r_bounds")


def clip_by_layer(features: DataFrame, mask: DataFrame, id_col: str, geometry: str = "geometry", size: float = 1000.0) -> DataFrame:
    """features cut to the union of a mask layer's polygons; those outside go, and so do null geometries on either side.

    Both sides are cut to grid cells of the given size first, and the mask's parts are united cell by cell, so no task holds more than
    a cell's polygons, and then a feature's own parts. id_col tells features apart; other columns are kept.
    """
    parts = cut_to_cells(features.select(id_col, geometry), geometry, size).drop("area")
    covers = cut_to_cells(mask.select(F.col(geometry).alias("m_geometry")), "m_geometry", size).drop("area")
    covers = _united(covers, ["row", "col"], "m_geometry")

    def both(g: pd.Series, m: pd.Series) -> pd.Series:
        found = [intersection(load_wkb(bytes(x)), load_wkb(bytes(y))) for x, y in zip(g, m)]
        return pd.Series([dump_wkb(p) if p else None for p in found], dtype=object)

    met = parts.hint("merge").join(covers, ["row", "col"]).withColumn(geometry, F.pandas_udf(both, "binary")(geometry, "m_geometry")).filter(F.col(geometry).isNotNull())
    whole = gathered(met.select(id_col, geometry), [id_col], geometry).withColumnsRenamed({id_col: "cl_id", geometry: "cl_geometry"})
    kept = [F.col("cl_geometry").alias(geometry) if c == geometry else F.col(f"`{c}`") for c in features.columns]
    return features.hint("merge").join(whole, F.col(id_col) == F.col("cl_id")).select(*kept)


def _by_group(parts: DataFrame, keys: list[str], geometry: str, whole) -> DataFrame:
    """keys and whole(polygons) of each group's geometries; a group for which that is empty goes. A task holds one group and one batch."""
    schema = parts.select(*keys, geometry).schema
    kinds = to_arrow_schema(schema)

    def batch(found: list[tuple[tuple, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in found], kinds.field(i).type) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([raw for _, raw in found], kinds.field(len(keys)).type)], names=kinds.names)

    def run(batches):
        last, own, found = None, [], []

        def close():
            result = whole([p for raw in own for p in load_wkb(raw)]) if own else []
            if result:
                found.append((last, dump_wkb(result)))

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(len(keys))]
            for key, raw in zip(zip(*columns) if keys else [()] * b.num_rows, b.column(len(keys)).to_pylist()):
                if own and key != last and repr(key) != repr(last):  # a number that is none equals itself here
                    close()
                    own = []
                last = key
                own.append(raw)
            if found:
                yield batch(found)
                found = []
        close()
        if found:
            yield batch(found)

    dealt = parts.select(*keys, geometry)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys) if keys else dealt.repartition(1)
    return dealt.mapInArrow(run, schema)


def gathered(parts: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """keys and one multipolygon of each group's parts, which don't overlap."""
    return _by_group(parts, keys, geometry, lambda polygons: polygons)


def cells_in_polygons(polygons: DataFrame, geometry: str, transform: tuple[float, float, float], all_touched: bool = False, tile: int = 256) -> DataFrame:
    """row and col of the raster cells that polygons burn: those whose centre lies inside, or all that share area with one.

    transform: x0, y0 (upper left corner) and cell size. Polygons are cut to tiles of cells first, so that a huge one is many rows' work.
    """
    x0, y0, res = transform

    def burn(g: pd.Series) -> pd.Series:
        out = []
        for raw in g:
            p = load_wkb(bytes(raw))
            bx0, by0, bx1, by1 = bounds_of(p)
            rows = np.arange(int(np.floor((y0 - by1) / res)), int(np.ceil((y0 - by0) / res)))
            cols = np.arange(int(np.floor((bx0 - x0) / res)), int(np.ceil((bx1 - x0) / res)))
            r, c = (v.ravel() for v in np.meshgrid(rows, cols, indexing="ij"))
            if all_touched:
                ok = [bool(clip_box(p, (x0 + j * res, y0 - (i + 1) * res, x0 + (j + 1) * res, y0 - i * res))) for i, j in zip(r, c)]
            else:
                ok = holds(p, x0 + (c + 0.5) * res, y0 - (r + 0.5) * res)
            out.append([{"row": int(i), "col": int(j)} for i, j, k in zip(r, c, ok) if k])
        return pd.Series(out, dtype=object)

    tiles = cut_to_cells(polygons.select(geometry), geometry, tile * res).select(F.pandas_udf(burn, "array<struct<row:int,col:int>>")(geometry).alias("b"))
    return tiles.select(F.explode("b").alias("b")).select("b.row", "b.col").distinct()


def clip_raster(cells: DataFrame, polygons: DataFrame, geometry: str, transform: tuple[float, float, float], all_touched: bool = False, nodata: float | None = None, crop: bool = True) -> DataFrame:
    """cells with valid (1 inside the polygons, else 0) and value null, or nodata, outside; with crop only rows and columns that the polygons' cells span."""
    from .raster import masked

    inside = cells_in_polygons(polygons, geometry, transform, all_touched)
    out = masked(cells, inside)
    if nodata is not None:
        out = out.withColumn("value", F.when(F.col("valid") == 1, F.coalesce("value", F.lit(nodata))).otherwise(nodata))
    if crop:
        b = inside.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        # One row is joined to all.
        out = out.join(F.broadcast(b), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")
    return out


def pixel_squares(cells: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """cells with geometry: each one's square; the grid's upper left corner is (x0, y0)."""

    def square(row: pd.Series, col: pd.Series) -> pd.Series:
        return pd.Series([dump_wkb(box_polygon(x0 + c * res, y0 - (r + 1) * res, x0 + (c + 1) * res, y0 - r * res)) for r, c in zip(row, col)], dtype=object)

    return cells.withColumn("geometry", F.pandas_udf(square, "binary")("row", "col"))


# ------------------------------------------------------------------ overlay


def _crossings(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, slope: np.ndarray, base: np.ndarray, some: int = 256) -> np.ndarray:
    """The heights at which edges, sorted by their lower ends, cross: blocks of edges against those that begin below their upper ends."""
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)
    found = [np.zeros(0)]
    for i in range(0, len(y0), some):
        own = slice(i, i + some)
        to = int(np.searchsorted(y0, y1[own].max(), side="left"))
        meet = np.flatnonzero((left[i:to] <= right[own].max()) & (right[i:to] >= left[own].min())) + i
        for k in range(0, len(meet), 1 << 14):
            m = meet[k : k + (1 << 14)]
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = (base[m][None, :] - base[own][:, None]) / (slope[own][:, None] - slope[m][None, :])
            ok = np.isfinite(cross) & (cross > np.maximum(y0[own][:, None], y0[m][None, :])) & (cross < np.minimum(y1[own][:, None], y1[m][None, :]))
            found.append(cross[ok])
    return np.concatenate(found)


def overlay(layers: list[list[Polygon]], keep) -> list[Polygon]:
    """The parts of the plane where keep(which layers cover it) holds, as trapezoids between horizontal lines.

    The lines run through all corners and crossings, so that between two of them no edges cross; going from left to right, each edge
    enters or leaves its polygon. Polygons of a layer may overlap; rings of a polygon are counted even-odd.
    """
    edges, owner, layer_of = [], [], []
    for k, polygons in enumerate(layers):
        for p in polygons:
            for r in p:
                for a, b in zip(r[:-1], r[1:]):
                    if a[1] != b[1]:
                        edges.append((*a, *b) if a[1] < b[1] else (*b, *a))
                        owner.append(len(layer_of))
            layer_of.append(k)
    if not edges:
        return []
    order = np.argsort([v[1] for v in edges], kind="stable")
    e, owner = np.array(edges)[order], [owner[i] for i in order]
    x0, y0, x1, y1 = e.T
    slope = (x1 - x0) / (y1 - y0)
    base = x0 - slope * y0
    ys = np.unique(np.concatenate([y0, y1, _crossings(x0, y0, x1, y1, slope, base)]))
    out: list[Polygon] = []
    active, entered = np.zeros(0, np.int64), 0
    for lo, hi in zip(ys[:-1], ys[1:]):
        after = int(np.searchsorted(y0, lo, side="right"))
        active = np.concatenate([active[y1[active] >= hi], np.arange(entered, after)])
        entered = after
        at = active
        mid = (lo + hi) / 2
        at = at[np.argsort(base[at] + slope[at] * mid, kind="stable")]
        state, covers, left = np.zeros(len(layer_of), bool), [0] * len(layers), None
        for i in at:
            p = owner[i]
            state[p] ^= True
            covers[layer_of[p]] += 1 if state[p] else -1
            on = bool(keep([c > 0 for c in covers]))
            if on and left is None:
                left = i
            elif not on and left is not None:
                xs = [base[left] + slope[left] * lo, base[i] + slope[i] * lo, base[i] + slope[i] * hi, base[left] + slope[left] * hi]
                if xs[1] > xs[0] or xs[2] > xs[3]:
                    out.append([np.array([[xs[0], lo], [xs[1], lo], [xs[2], hi], [xs[3], hi], [xs[0], lo]])])
                left = None
    return out


def intersection(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return overlay([a, b], all)


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return overlay([a, b], lambda c: c[0] and not c[1])


def dissolved(polygons: list[Polygon]) -> list[Polygon]:
    return overlay([polygons], any)


def _kinds(df: DataFrame, keys: list[str], *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys] + list(more))


def _united(features: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """keys and the union of each group's geometries; a group is gathered."""
    return _by_group(features, keys, geometry, dissolved)


def dissolve(features: DataFrame, keys: list[str], geometry: str = "geometry", size: float = 1000.0) -> DataFrame:
    """keys and the union of each group's geometries; null where a group has none with an area.

    Geometries are cut to grid cells of the given size and united cell by cell; only the parts, which don't overlap any more, are
    gathered into a group's one geometry.
    """
    parts = cut_to_cells(features.select(*keys, geometry), geometry, size).drop("area").withColumnsRenamed({"row": "ds_row", "col": "ds_col"})
    whole = gathered(_united(parts, [*keys, "ds_row", "ds_col"], geometry), keys, geometry)
    names = {k: f"ds_{i}" for i, k in enumerate(keys)}
    joined = features.select(*keys).distinct().hint("merge").join(whole.withColumnsRenamed(names), on=[F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], how="left")
    return joined.select(*keys, geometry)


def subtract(features: DataFrame, others: DataFrame, id_col: str, geometry: str = "geometry", size: float = 1000.0) -> DataFrame:
    """features without what any of the others covers; those that vanish go, and so do null geometries.

    Both are cut to grid cells of the given size, the others are united cell by cell, and what is left of a feature is gathered. id_col
    tells features apart; those that meet no other keep their geometry as it is.
    """
    own = features.filter(F.col(geometry).isNotNull())
    parts = cut_to_cells(own.select(id_col, geometry), geometry, size).drop("area")
    covers = _united(cut_to_cells(others.select(F.col(geometry).alias("m_geometry")), "m_geometry", size).drop("area"), ["row", "col"], "m_geometry")

    def cut(g: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for raw, cover in zip(g, m):
            part = load_wkb(bytes(raw))
            part = part if cover is None else difference(part, load_wkb(bytes(cover)))
            out.append(dump_wkb(part) if part else None)
        return pd.Series(out, dtype=object)

    left = parts.hint("merge").join(covers, ["row", "col"], "left").withColumn("sb_met", F.col("m_geometry").isNotNull()).withColumn(geometry, F.pandas_udf(cut, "binary")(geometry, "m_geometry"))
    met = left.groupBy(F.col(id_col).alias("sb_id")).agg(F.max("sb_met").alias("sb_met"))
    whole = gathered(left.filter(F.col(geometry).isNotNull()).select(id_col, geometry), [id_col], geometry).withColumnsRenamed({id_col: "sb_own", geometry: "sb_geometry"})
    joined = own.hint("merge").join(met, F.col(id_col) == F.col("sb_id"), "left").hint("merge").join(whole, F.col(id_col) == F.col("sb_own"), "left")
    new = F.when(F.coalesce("sb_met", F.lit(False)), F.col("sb_geometry")).otherwise(F.col(geometry))
    kept = [new.alias(geometry) if c == geometry else F.col(f"`{c}`") for c in features.columns]
    return joined.select(*kept).filter(F.col(geometry).isNotNull())


def common_to_all(features: DataFrame, layer: str, layers: list[str], geometry: str = "geometry", keys: list[str] | None = None, size: float = 1000.0) -> DataFrame:
    """keys, the geometry that all layers share, and their names joined by commas; keys without such a geometry are left out.

    Layers meet cell by cell of a grid of the given size; the parts that they share are gathered.
    """
    keys = keys or []
    names = sorted(layers)
    cell = [*keys, "cm_row", "cm_col"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {k: [p for raw in g[geometry] for p in load_wkb(bytes(raw))] for k, g in pdf.groupby(layer)}
        parts = overlay([by[n] for n in names], all) if all(n in by for n in names) else []
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in cell}, geometry: dump_wkb(parts)}] if parts else [], columns=[*cell, geometry])

    rows = features.filter(F.col(layer).isin(names)).select(*keys, layer, geometry)
    parts = cut_to_cells(rows, geometry, size).drop("area").withColumnsRenamed({"row": "cm_row", "col": "cm_col"})
    shared = parts.groupBy(*cell).applyInPandas(meet, _kinds(parts, cell, f"`{geometry}` binary"))
    return gathered(shared, keys, geometry).withColumn("layers", F.lit(",".join(names)))


def outline(cells: set[tuple[int, int]], x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> list[Polygon]:
    """The rings around a set of (row, col) cells: edges between two cells of the set cancel, the others are followed."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for (a, b), other in ((((r, c), (r, c + 1)), (r - 1, c)), (((r, c + 1), (r + 1, c + 1)), (r, c + 1)), (((r + 1, c + 1), (r + 1, c)), (r + 1, c)), (((r + 1, c), (r, c)), (r, c - 1))):
            if other not in cells:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, way = [start], start, None
        while True:
            found = edges[at]
            # Where two rings touch, turn right, so that each stays on its own cell.
            nxt = found[0] if len(found) == 1 or way is None else max(found, key=lambda b: (b[0] - at[0]) * way[1] - (b[1] - at[1]) * way[0])
            found.remove(nxt)
            if not found:
                del edges[at]
            way = (nxt[0] - at[0], nxt[1] - at[1])
            at = nxt
            ring.append(at)
            if at == start:
                break
        corners = [p for i, p in enumerate(ring[:-1]) if (p[0] - ring[i - 1 if i else -2][0], p[1] - ring[i - 1 if i else -2][1]) != (ring[i + 1][0] - p[0], ring[i + 1][1] - p[1])]
        rings.append(np.array([(x0 + c * res, y0 - r * res) for r, c in [*corners, corners[0]]], float))
    shells = [[r] for r in rings if _ring_area(r) < 0]
    for hole in (r for r in rings if _ring_area(r) > 0):
        # A point just inside the hole's first corner tells which shell holds it.
        q = hole[:-1].mean(axis=0) if len(hole) == 5 else hole[0]
        home = [s for s in shells if holds([[s[0]]], np.array([q[0]]), np.array([q[1]]))[0]]
        (min(home, key=lambda s: abs(_ring_area(s[0]))) if home else shells[0]).append(hole)
    return shells


def region_polygons(cells: DataFrame, keys: list[str], x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """keys, n and geometry: the outline of each key's cells. A key's cells become one geometry, so they are gathered."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        own = set(zip(pdf["row"].astype(int), pdf["col"].astype(int)))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(own), "geometry": dump_wkb(outline(own, x0, y0, res))}])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in keys] + ["n long", "geometry binary"])
    return cells.select(*keys, "row", "col").groupBy(*keys).applyInPandas(trace, kinds)


def intersecting(features: DataFrame, geometry: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Whole features that share some area with a rectangle."""

    def touch(g: pd.Series) -> pd.Series:
        return pd.Series([raw is not None and bool(clip_box(load_wkb(bytes(raw)), box)) for raw in g])

    return features.filter(F.pandas_udf(touch, "boolean")(geometry))
