"""Empty tables, nulls, repeated rows and extra columns in the analytics operators."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenmark.operators import area, geometry, grid, index_tables, metrics, raster, split, stability, survey, timeseries
from fenmark.operators.numbering import numbered
from fenmark.sources import geotiff, text


def box(*b):
    return geometry.dump_wkb(geometry.box_polygon(*b))


@pytest.fixture(scope="module")
def shapes(spark):
    """A square twice, a null, a touching neighbour, and columns whose names are those that operators use."""
    rows = [("a", box(0, 0, 2, 2)), ("a2", box(0, 0, 2, 2)), ("none", None), ("b", box(2, 0, 4, 2))]
    df = spark.createDataFrame(rows, "id string, geometry binary")
    for c in ("layer", "years", "label", "n"):
        df = df.withColumn(c, F.lit("2020"))
    return df


def areas(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys, F.round(geometry.st_area(F.col("geometry")), 9)).collect()), key=repr)


def test_geometry(spark, shapes):
    none = shapes.limit(0)
    mask = spark.createDataFrame([(box(1, 0, 3, 2),), (box(1, 0, 3, 2),), (None,)], "geometry binary")
    assert areas(geometry.clip_by_layer(shapes, mask, "id"), "id") == [("a", 2.0), ("a2", 2.0), ("b", 2.0)]
    assert geometry.clip_by_layer(shapes, mask, "id").columns == shapes.columns
    assert areas(geometry.subtract(shapes, mask, "id"), "id") == [("a", 2.0), ("a2", 2.0), ("b", 2.0)]
    assert areas(geometry.dissolve(shapes, ["layer"]), "layer") == [("2020", 8.0)]
    assert areas(geometry.dissolve(shapes.filter("geometry is null"), ["id"]), "id") == [("none", None)]
    assert areas(geometry.dissolve(shapes, ["id"], size=0.5), "id") == [("a", 4.0), ("a2", 4.0), ("b", 4.0), ("none", None)]
    for out in (geometry.clip_by_layer(none, mask, "id"), geometry.clip_by_layer(shapes, mask.limit(0), "id"), geometry.subtract(none, mask, "id"), geometry.dissolve(none, ["id"]), geometry.common_to_all(none, "id", ["a", "b"]), geometry.cut_to_cells(none, "geometry", 1.0)):
        assert out.count() == 0
    assert geometry.subtract(shapes, mask.limit(0), "id").count() == 3
    pairs = geometry.meeting(shapes.select("id", "geometry"), shapes.select(F.col("id").alias("other"), F.col("geometry").alias("o")), "geometry", "o", 1.0)
    assert sorted((r.id, r.other) for r in pairs.collect()) == [("a", "a"), ("a", "a2"), ("a2", "a"), ("a2", "a2"), ("b", "b")]  # an edge in common is no area
    points = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 1.0)], "x double, y double")
    assert geometry.points_in_polygons(points, shapes).count() == 4


def test_masks(spark, shapes):
    cells = spark.range(5).crossJoin(spark.range(5).withColumnRenamed("id", "j")).select(F.col("id").cast("int").alias("row"), F.col("j").cast("int").alias("col"), F.lit(1.0).alias("value"))
    out = geometry.clip_raster(cells, shapes, "geometry", (0.0, 5.0, 1.0))
    assert out.count() == 8 and out.filter("valid = 1 and value = 1").count() == 8  # rows 3 and 4, columns 0 to 3
    assert geometry.clip_raster(cells, shapes, "geometry", (0.0, 5.0, 1.0), crop=False).filter("valid = 0 and value is null").count() == 17
    assert geometry.clip_raster(cells, shapes.limit(0), "geometry", (0.0, 5.0, 1.0)).count() == 0
    assert geometry.clip_raster(cells.limit(0), shapes, "geometry", (0.0, 5.0, 1.0)).count() == 0


def test_overlay_of_many_edges():
    """Blocks of edges find all crossings: areas of a comb across stripes."""
    comb = [geometry.box_polygon(2 * i, 0, 2 * i + 1, 100)[0] for i in range(150)]
    stripes = [geometry.box_polygon(0, 2 * i, 300, 2 * i + 1)[0] for i in range(50)]
    assert geometry.area_of(geometry.intersection(comb, stripes)) == pytest.approx(150 * 50)
    skew = [[np.array([[0.0, 0.0], [300.0, 50.0], [300.0, 51.0], [0.0, 1.0], [0.0, 0.0]])]]
    assert geometry.area_of(geometry.intersection(comb, skew)) == pytest.approx(150.0)


def test_grids_and_rasters(spark):
    cells = spark.createDataFrame([(0, 0, 1, 5.0), (0, 0, 1, 5.0), (0, 1, None, None), (3, 3, 2, 7.0)], "row int, col int, value int, v double")
    none = cells.limit(0)
    assert sorted((r.row, r.col, r.neighbours) for r in grid.neighbour_counts(cells).collect()) == [(0, 0, 1), (0, 1, 1), (3, 3, 0)]
    assert grid.regions(cells.distinct()).count() == 2 and grid.regions(none).count() == 0 and grid.neighbour_counts(none).count() == 0
    assert raster.downsampled(cells, 2, "value", "mode").orderBy("row").first().value == 1
    assert raster.mosaic_first(none, "v", "value").count() == 0 and raster.stretch(none, "v").count() == 0
    assert {r.unit for r in raster.stretch(cells, "v").collect()} == {0.0, None, 1.0}
    assert raster.aligned(none, (0.0, 1.0, 1.0), (0.0, 1.0, 1.0), 2, 2).count() == 0
    assert raster.masked(cells, none).filter("value is not null").count() == 0
    meta = spark.createDataFrame([("a", None, 1, 1, 0.0, 0.0, 1.0), ("b", "EPSG:1", 1, 1, 0.0, 0.0, 1.0)], "raster string, crs string, height int, width int, x0 double, y0 double, res double")
    assert {r.raster: r.same for r in raster.compare_grids(meta, "a").collect()} == {"a": False, "b": False}  # nothing is known of the reference's system
    assert numbered(none, ["row"]).count() == 0 and [r.n for r in numbered(cells, ["row", "col"]).orderBy("n").collect()] == [1, 2, 3, 4]


def test_rows_for_maps(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "2018, ..., 2020"), (3, "2018, ..., 2020")], "id int, years string")
    ref = spark.createDataFrame([(1, "x"), (3, "y"), (3, "y"), (None, "z")], "id int, division string")
    assert sorted(r.year for r in survey.map_rows(rows, ref, "id", "division").collect()) == ["2018", "2018", "2019", "2019", "2020", "2020"]
    assert survey.map_rows(rows.limit(0), ref, "id", "division").count() == 0
    assert survey.year_sets(spark.createDataFrame([], "raster string, year int")).count() == 0
    with pytest.raises(KeyError):
        survey.chosen({"a": 1}, ["a", "b"])
    assert survey.chosen({"a": 1, "c": 2}, ["c", "b"], allow_missing=True) == {"c": 2}
    with pytest.raises(ValueError):
        survey.background(rows, "gray")


def test_metrics_and_profiles(spark):
    pairs = spark.createDataFrame([(1, "a", None), (1, None, "a"), (1, "a", "a"), (1, "a", "a")], "year int, t string, p string")
    assert metrics.accuracy(pairs.limit(0), ["year"], "t", "p").count() == 0
    assert metrics.confusion(pairs, ["year"], "t", "p").agg(F.sum("c")).first()[0] <= 4
    obs = spark.createDataFrame([], "k int, class string")
    assert stability.stability_profile(obs, ["k"]).count() == 0 and stability.value_percentages(obs, "class").count() == 0
    assert area.class_shares(obs, ["k"], "class").count() == 0
    assert index_tables.all_years(spark.createDataFrame([(1, None, "2010")], "id int, c string, y string"), "c", "y", "id").count() == 0


def test_split_of_an_empty_index_and_a_class_without_room(spark):
    index = spark.createDataFrame([("A", "2020", "P_1_1"), ("A", "2020", "P_1_2"), ("A", "2021", "P_1_1"), (None, "2020", "Q_1")], "class string, year string, id string")
    cells = spark.createDataFrame([("P_1_1", 0, 0), ("P_1_2", 0, 1), ("Q_1", 9, 9)], "id string, row int, col int")
    out = split.train_val_split(index, cells, split.SplitPlan(cap=10, shares=(0.5, 0.5, 0.0)))
    assert out.count() == 4
    used = out.filter("split <> 'leftover' and class = 'A'").select("year", "split").distinct().collect()
    assert len(used) == 1  # a polygon serves one year and one split
    assert split.train_val_split(index.limit(0), cells, split.SplitPlan(cap=10)).count() == 0


def test_split_in_memory_and_by_tables_agree(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([("AB"[p % 2], str(2017 + y), f"GI_{p}_{i}", i // 5, i % 5) for p in range(60) for y in range(1 + p % 2) for i in range(int(rng.integers(1, 25)))], columns=["class", "year", "id", "row", "col"])
    cells = spark.createDataFrame(rows[["id", "row", "col"]].drop_duplicates())
    plan = split.SplitPlan(cap=80, shares=(0.5, 0.3, 0.2), large=9)
    got = split.train_val_split(spark.createDataFrame(rows[["class", "year", "id"]]), cells, plan).toPandas()
    for c in "AB":
        mine = rows[rows["class"] == c].assign(polygon=lambda d: d["id"].str.replace(r"_\d+$", "", regex=True))
        want = split.split_class(mine, plan)
        key = lambda d: sorted(zip(d["year"], d["id"], d["split"]))
        assert key(got[got["class"] == c]) == key(want)


def test_series(spark):
    daily = spark.createDataFrame([], "station int, date date, p double, e double")
    assert timeseries.monthly_sums(daily, "station", "date", ["p"]).count() == 0 and timeseries.common_period(daily, "station", "date", ["p", "e"]).count() == 0
    few = spark.createDataFrame([(1, "2020-01-01", 5.0)], "station int, month string, water_balance double").withColumn("month", F.to_date("month"))
    assert [r.spei for r in timeseries.drought_index(few, scales=range(1, 2)).collect()] == [None]


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [1e-9, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6, 1.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(timeseries.normal_quantile(F.col("p"))).collect()]
    assert got[-1] is None
    for v, g in zip(p[:-1], got):
        assert g == pytest.approx(NormalDist().inv_cdf(min(max(v, 1e-6), 1 - 1e-6)), rel=2e-9, abs=1e-9)


def test_big_and_float_differenced_tiff(tmp_path, spark):
    """A big TIFF with floating-point differences, made by hand."""
    import struct
    import zlib

    data = np.linspace(-5, 9, 6 * 7).astype(np.float32).reshape(6, 7)
    planes = data.astype(">f4").view(np.uint8).reshape(6, 7, 4).transpose(0, 2, 1).reshape(6, 28)
    delta = planes.copy()
    delta[:, 1:] = planes[:, 1:] - planes[:, :-1]
    raw = zlib.compress(delta.tobytes())
    fields = [(256, 3, 7), (257, 3, 6), (258, 3, 32), (259, 3, 8), (273, 16, 16), (277, 3, 1), (278, 3, 6), (279, 16, len(raw)), (317, 3, 3), (339, 3, 3)]
    at = 16 + len(raw)
    body = struct.pack("<Q", len(fields)) + b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in fields) + struct.pack("<Q", 0)
    path = tmp_path / "big.tif"
    path.write_bytes(b"II" + struct.pack("<HHHQ", 43, 8, 0, at) + raw + body)
    got = {(r.row, r.col): r.b1 for r in geotiff.read_geotiff(spark, str(path)).collect()}
    assert got == {(i, j): float(data[i, j]) for i in range(6) for j in range(7)}


def test_class_lists(spark):
    lines = spark.createDataFrame([("- 1: a: b",), ("  -2 :c  ",), ("-x: d",), ("3: e",), ("- 4:",), ("",), (None,), ("-",)], "value string")
    assert sorted(tuple(r) for r in text.class_list(lines).collect()) == [(1, "a: b"), (2, "c")]


def test_split_never_broadcasts_pixels(spark):
    """A short table may have very many pixels: Spark's guess of their size comes from the table."""
    ids = spark.range(5).select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("col"), F.concat_ws("_", F.lit("P"), F.col("id").cast("string"), "col").alias("id"))
    index = ids.select(F.lit("A").alias("class"), F.lit("2020").alias("year"), "id")
    out = split.train_val_split(index, ids.select("id", F.lit(1).alias("row"), "col"), split.SplitPlan(cap=10))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[id#\d+L?\], \[id#", plan) and not re.search(r"BroadcastHashJoin \[id#\d+L?\], \[id#", plan)


def test_split_queries_join_pixels_by_shuffles(spark, sf):
    from fenmark.plans import registry

    for name in ("train_val_split", "split_invariants"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[p_partkey#\d+L\], \[p_partkey#", plan) and not re.search(r"BroadcastHashJoin \[(id|p_partkey)#", plan)


def test_points_in_polygons_meet_by_shuffles(spark):
    """Repeated places and geometries count as often as they occur; however small the tables seem, nothing is broadcast."""
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 3.0, 1.0), (4, None, 1.0)], "p int, x double, y double")
    polygons = spark.createDataFrame([("a", box(0, 0, 2, 2)), ("a2", box(0, 0, 2, 2)), ("none", None), ("b", box(2, 0, 4, 2))], "id string, geometry binary")
    out = geometry.points_in_polygons(points, polygons, size=1.0)
    assert sorted((r.p, r.id) for r in out.collect()) == [(1, "a"), (1, "a2"), (2, "a"), (2, "a2"), (3, "b")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("whole", [False, True])
def test_features_are_dealt_out_and_cut_once(spark, whole):
    """One short file is not one task's work, and no filter runs the cut again."""
    one = spark.createDataFrame([("a", box(0, 0, 2.5, 2))], "id string, geometry binary").coalesce(1)
    out = geometry.cut_to_cells(one, "geometry", 1.0, whole)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [cut(") == 1 and "RoundRobinPartitioning" in plan
    assert sorted((r.row, r.col, r.area) for r in out.collect()) == [(i, j, 1.0 if j < 2 else 0.5) for i in (0, 1) for j in range(2 if whole else 3)]


def test_clipping_many_is_clipping_each():
    rng = np.random.default_rng(4)
    raws, boxes = [], []
    for _ in range(300):
        rings = lambda: [np.vstack([r, r[:1]]) if rng.random() < 0.95 else r for r in (np.round(rng.uniform(0, 12, (int(rng.integers(1, 8)), 2))) / 2 for _ in range(int(rng.integers(1, 3))))]
        raw = geometry.dump_wkb([rings() for _ in range(int(rng.integers(1, 3)))])
        for i, j in rng.integers(0, 5, (3, 2)):
            raws.append(raw)
            boxes.append((i, j, i + 2, j + 2))
    got, area_ = geometry.clip_boxes(raws, np.array(boxes, float))
    want = [geometry.clip_box(geometry.load_wkb(r), b) for r, b in zip(raws, boxes)]
    assert [geometry.dump_wkb(g) for g in got] == [geometry.dump_wkb(w) for w in want]
    assert np.allclose(area_, [geometry.area_of(w) for w in want], atol=1e-9)
    raw, area_of_raw = geometry.clip_boxes_wkb(raws, np.array(boxes, float))
    assert list(raw) == [geometry.dump_wkb(w) if w else None for w in want] and np.array_equal(area_of_raw, area_)
    assert len(geometry.clip_boxes_wkb([], np.zeros((0, 4)))[0]) == 0


def test_cut_parts_are_written_many_at_a_time(monkeypatch):
    """A feature's parts with one ring cost no call each."""
    calls = []
    dump, n = geometry.dump_wkb, 500
    raws, boxes = [box(0, 0, 30.5, 30)] * n, np.array([(i % 25, i // 25, i % 25 + 1, i // 25 + 1) for i in range(n)], float)
    monkeypatch.setattr(geometry, "dump_wkb", lambda p: calls.append(p) or dump(p))
    raw, area_ = geometry.clip_boxes_wkb(raws, boxes)
    assert not calls and area_.tolist() == [1.0] * n
    assert [geometry.bounds_of(geometry.load_wkb(r)) for r in raw] == [tuple(b) for b in boxes]


def test_faults_of_a_split_are_counted_in_one_reading(spark):
    rows = [("a", "2017", "p", "train"), ("a", "2018", "p", "val"), ("a", "2017", "q", "train"), ("a", "2017", "q", "leftover"), ("a", "2017", "r", "leftover"), ("b", "2017", "p", None), (None, "2017", "p", "train"), (None, "2017", "p", "val")]
    rows += [("b", "2017", "s", "test")] * 3 + [("b", "2017", "t", "test")] * 2 + [("b", "2019", "t", "leftover")]
    out = split.split_faults(spark.createDataFrame(rows, "class string, year string, polygon string, split string"), 2)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_groups_of_polygons_stream_through_batches(spark):
    """A group may go on from one batch to the next, a batch may hold many groups, and a null key is a key."""
    rows = [(k, box(i, 0, i + 1.5, 1)) for k in ("a", "b", None, "c") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, geometry binary")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (2, 3, 100):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            out = geometry.dissolve(df, ["k"], size=2.0)
            assert sorted((str(r.k), round(r.a, 9)) for r in out.select("k", geometry.st_area(F.col("geometry")).alias("a")).collect()) == [("None", 5.5), ("a", 5.5), ("b", 5.5), ("c", 5.5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    # A call to Python for each of very many small groups takes longer than their union.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Broadcast" not in plan
