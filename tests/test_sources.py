import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenmark.operators import geometry as G
from fenmark.sources import geotiff, gpkg, text


def test_geotiff_round_trip(spark, tmp_path):
    data = np.arange(2 * 70 * 90, dtype=np.int16).reshape(2, 70, 90)
    data[0, 3, 4] = -9999
    path = str(tmp_path / "a.tif")
    geotiff.write_geotiff(path, data, (100.0, 200.0, 10.0), -9999)
    got = geotiff.read_geotiff(spark, path).collect()
    assert len(got) == 70 * 90
    for r in got:
        assert (r.b1, r.b2) == (None if (r.row, r.col) == (3, 4) else float(data[0, r.row, r.col]), float(data[1, r.row, r.col]))
    meta = geotiff.raster_meta(spark, [path]).first()
    assert (meta.height, meta.width, meta.bands, meta.x0, meta.y0, meta.res, meta.nodata) == (70, 90, 2, 100.0, 200.0, 10.0, -9999.0)


def test_lzw():
    """A bit writer that follows the decoder's widths, over texts that repeat."""

    def encode(raw: bytes) -> bytes:
        codes, table, out, w = [], {bytes([i]): i for i in range(256)}, [], b""
        size, width = 258, 9
        bits = []

        def put(c):
            bits.append(format(c, f"0{width}b"))

        put(256)
        for b in raw:
            if w + bytes([b]) in table:
                w += bytes([b])
                continue
            put(table[w])
            table[w + bytes([b])] = size
            size += 1
            width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
            w = bytes([b])
        if w:
            put(table[w])
            size += 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        put(257)
        s = "".join(bits)
        s += "0" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))

    raw = bytes((i * i // 7) % 11 for i in range(3000))
    assert geotiff.lzw(encode(raw)) == raw


def test_gpkg_round_trip(spark, tmp_path):
    square = G.dump_wkb(G.box_polygon(0, 0, 2, 2))
    df = spark.createDataFrame([(1, "a", square), (2, None, None)], "n long, name string, geometry binary")
    path = str(tmp_path / "a.gpkg")
    assert gpkg.write_gpkg(df, path, "things", 28992)
    assert not gpkg.write_gpkg(df, path, "things", 28992, mode="ignore")
    with pytest.raises(FileExistsError):
        gpkg.write_gpkg(df, path, "things", 28992)
    assert gpkg.layers(path) == ["things"]
    got = sorted(map(tuple, gpkg.read_gpkg(spark, path).collect()))
    assert got == [(1, "a", bytearray(square)), (2, None, None)]
    assert gpkg.read_gpkg(spark, path, columns=["n", "absent"]).columns == ["n", "geometry"]
    with pytest.raises(ValueError):
        gpkg.layers("a.txt")


def test_station_file(spark, tmp_path):
    p = tmp_path / "days.txt"
    p.write_text("# comment\nSTN,YYYYMMDD, TG, RH, EV24\n\n  260,20200101,   55,   -1,    3\n  260,20200102,   60,     ,    4\n")
    rows = text.trace_precipitation(text.read_station_days(spark, str(p), ["temp_c", "precip_mm", "pet_mm"])).orderBy("date").collect()
    assert [(r.station, r.temp_c, r.precip_mm, r.pet_mm) for r in rows] == [(260, 5.5, 0.05, 0.3), (260, 6.0, None, 0.4)]


def test_class_list_and_paths(spark, tmp_path):
    p = tmp_path / "README.md"
    p.write_text("Classes\n- 1: dry heath\n - 12: bog \nother\n")
    assert sorted(map(tuple, text.read_class_list(spark, str(p)).collect())) == [(1, "dry heath"), (12, "bog")]
    assert text.period_path("b", 2020, "Q3") == "b/year=2020/timeframe=Q3"
    with pytest.raises(ValueError):
        text.period_path("b", 2020, "Q5")


def test_periods_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(2020, "Q1", 1), (2021, "Q2", 2)], "year int, timeframe string, v int")
    text.write_periods(df, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter("year = 2020")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_measures():
    hole = [np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float), np.array([[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]], float)]
    assert G.area_of([hole]) == 15
    assert G.load_wkb(G.dump_wkb([hole]))[0][1].tolist() == hole[1].tolist()
    assert G.holds([hole], np.array([0.5, 1.5, 5.0]), np.array([0.5, 1.5, 1.0])).tolist() == [True, False, False]
    assert G.area_of(G.clip_box([hole], (0, 0, 2, 2))) == pytest.approx(3)
    assert G.centroid_of(G.box_polygon(2, 2, 4, 6)) == pytest.approx((3, 4))


def test_reprojection():
    """The origin of the grid, and round trips."""
    x, y = G.reproject_points(np.array([155000.0]), np.array([463000.0]), 28992, 4326)
    assert (x[0], y[0]) == pytest.approx((5.38720621, 52.15517440), abs=1e-8)
    px, py = np.array([180000.0, 200000.0]), np.array([440000.0, 470000.0])
    back = G.reproject_points(*G.reproject_points(px, py, 28992, 32631), 32631, 28992)
    assert np.allclose(back[0], px, atol=0.5) and np.allclose(back[1], py, atol=0.5)
    e, n = G.geographic_to_utm(np.array([3.0]), np.array([0.0]))
    assert (e[0], n[0]) == pytest.approx((500000.0, 0.0), abs=1e-6)
    lon, lat = G.utm_to_geographic(*G.geographic_to_utm(np.array([5.9]), np.array([52.1])))
    assert (lon[0], lat[0]) == pytest.approx((5.9, 52.1), abs=1e-8)


def test_spatial_join_and_cut(spark):
    triangle = G.dump_wkb([[np.array([[0, 0], [4, 0], [0, 4], [0, 0]], float)]])
    polygons = spark.createDataFrame([("t", triangle), ("none", None)], "name string, geometry binary")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 0.5, 3.2)], "id int, x double, y double")
    assert sorted(r.id for r in G.points_in_polygons(points, polygons, size=1.5).collect()) == [1, 3]
    parts = G.cut_to_cells(polygons, "geometry", 1.0).collect()
    assert math.isclose(sum(r.area for r in parts), 8) and len(parts) == 10
    assert G.cut_to_cells(polygons, "geometry", 1.0, whole=True).count() == 6
    assert G.clip_features(polygons, "geometry", (0, 0, 1, 1)).select(G.st_area(F.col("geometry"))).first()[0] == 1
    squares = G.pixel_squares(spark.createDataFrame([(0, 1)], "row int, col int"), 10.0, 20.0, 2.0)
    assert squares.select(G.st_bounds(F.col("geometry"))).first()[0] == [12.0, 18.0, 14.0, 20.0]


def star(cx, cy, k, r, seed):
    rng = np.random.default_rng(seed)
    a = (np.arange(k) + 0.8 * rng.random(k)) / k * 2 * math.pi
    p = np.column_stack([cx + np.cos(a) * r * (0.4 + rng.random(k)), cy + np.sin(a) * r * (0.4 + rng.random(k))])
    return [[np.concatenate([p, p[:1]])]]


def test_overlay_by_sampling():
    """Areas add up, and points fall where they should."""
    a, b = star(0, 0, 14, 5, 1), star(2, 1, 11, 5, 2)
    both, less, union = G.intersection(a, b), G.difference(a, b), G.overlay([a, b], any)
    assert G.area_of(both) + G.area_of(less) == pytest.approx(G.area_of(a))
    assert G.area_of(union) == pytest.approx(G.area_of(a) + G.area_of(b) - G.area_of(both))
    x, y = np.random.default_rng(3).uniform(-8, 10, (2, 4000))
    ina, inb = G.holds(a, x, y), G.holds(b, x, y)
    assert (G.holds(both, x, y) == (ina & inb)).all() and (G.holds(less, x, y) == (ina & ~inb)).all()
    assert G.difference(a, a) == [] and G.area_of(G.dissolved(a + b)) == pytest.approx(G.area_of(union))


def test_dissolve_subtract_and_common(spark):
    box = lambda *b: G.dump_wkb(G.box_polygon(*b))
    df = spark.createDataFrame([("a", 1, box(0, 0, 2, 2)), ("b", 1, box(1, 0, 3, 2)), ("c", 2, box(10, 10, 11, 11)), ("d", 2, None)], "id string, k int, geometry binary")
    area = lambda d, *c: sorted(map(tuple, d.select(*c, F.round(G.st_area(F.col("geometry")), 9)).collect()))
    assert area(G.dissolve(df, ["k"]), "k") == [(1, 6.0), (2, 1.0)]
    others = spark.createDataFrame([(box(1, 1, 5, 5),), (box(9, 9, 12, 12),)], "geometry binary")
    assert area(G.subtract(df, others, "id", size=2.0), "id") == [("a", 3.0), ("b", 2.0)]
    years = spark.createDataFrame([("2020", box(0, 0, 2, 2)), ("2021", box(1, 1, 3, 3)), ("2021", box(0, 0, 1, 1))], "year string, geometry binary")
    assert area(G.common_to_all(years, "year", ["2020", "2021"]), "layers") == [("2020,2021", 2.0)]
    assert G.common_to_all(years, "year", ["2020", "2022"]).count() == 0
    assert G.intersecting(df, "geometry", (0, 0, 0.5, 0.5)).select("id").collect() == [("a",)]


def test_outlines(spark):
    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    shells = G.outline(set(ring))
    assert len(shells) == 1 and len(shells[0]) == 2 and G.area_of(shells) == 8
    corner = G.outline({(0, 0), (1, 1)})
    assert len(corner) == 2 and G.area_of(corner) == 2
    cells = spark.createDataFrame([(1, r, c) for r, c in ring] + [(2, 9, 9)], "region int, row int, col int")
    got = G.region_polygons(cells, ["region"], 100.0, 50.0, 10.0).select("region", "n", G.st_area(F.col("geometry")).alias("a")).collect()
    assert sorted(map(tuple, got)) == [(1, 8, 800.0), (2, 1, 100.0)]


def test_excel(spark, tmp_path):
    import zipfile

    from fenmark.sources import xlsx

    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><t>name</t></si><si><t>bog</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>fen</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in xlsx.read_xlsx(spark, path).collect()] == [("7", "bog"), (None, "fen")]
    assert xlsx.read_xlsx(spark, path, columns=["name", "absent"]).columns == ["name"]
