"""Small tables with results worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenmark.functions import scalars as S
from fenmark.operators import grid, index_tables, metrics, raster, split, stability, survey, timeseries

SEQUENCES = [
    ([1, 1, 1, 1, 1, 1, 1], (1, 1.0, None, 0.0, 0.0, 1)),
    ([1, 1, 1, 1, 1, 1, 2], (1, 6 / 7, 2, 1 / 7, 0.5917, 1)),
    ([1, 1, 1, 1, 1, 2, 2], (1, 5 / 7, 2, 2 / 7, 0.8631, 2)),
    ([3, 3, 3, 1, 2], (3, 0.6, 1, 0.2, 0.8650, 3)),
    ([1, 1, 1, 2, 2, 2, 3], (1, 3 / 7, 2, 3 / 7, 0.9141, 4)),
    ([2, 2, 1, 1], (1, 0.5, 2, 0.5, 1.0, 4)),
    ([1, 1, 1, 1, 2, 2, 3], (1, 4 / 7, 2, 2 / 7, 0.8699, 5)),
]


def test_stability_profile(spark):
    rows = [(i, c) for i, (seq, _) in enumerate(SEQUENCES) for c in seq] + [(99, 1), (99, None), (99, 1)]
    got = {r[0]: tuple(r)[1:] for r in stability.stability_profile(spark.createDataFrame(rows, "pixel int, class int"), ["pixel"]).collect()}
    assert 99 not in got
    for i, (_, want) in enumerate(SEQUENCES):
        for g, w in zip(got[i], want):
            assert g == w or math.isclose(g, w, abs_tol=5e-5)


def test_middle_threshold_of_the_notebooks(spark):
    df = spark.createDataFrame([(0.6, 0.2), (0.7143, 0.2857), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(stability.decision_category(F.col("a"), F.col("b"), {"med_winner_min": 0.6})).collect()]
    assert got == [2, 2, None]


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame(
        [("GI_1", "A", "2015, 2018", 100.0, 250.0), ("GI_2", "A", "2018", 80.0, 99.0), ("GI_10", "B", "2012,2015", 90.0, 1000.0), ("GI_3", "B", None, 100.0, 500.0), ("GI_4", None, "2018", 100.0, 500.0)],
        "id string, cls string, years string, pct double, area double",
    )


def lists(index):
    return {(r["class"], r["year"]): r["ids"] for r in index_tables.as_lists(index).collect()}


def test_index_tables(spark, polygons):
    tmp0 = index_tables.all_years(polygons, "cls", "years", "id")
    assert lists(tmp0) == {("A", "2015"): ["GI_1"], ("A", "2018"): ["GI_1", "GI_2"], ("B", "2012"): ["GI_10"], ("B", "2015"): ["GI_10"]}
    tmp1 = index_tables.early_bucket(polygons, "cls", "years", "id")
    assert lists(tmp1) == {("A", "2010-2016"): ["GI_1"], ("A", "2018"): ["GI_1", "GI_2"], ("B", "2010-2016"): ["GI_10", "GI_10"]}
    tmp2 = index_tables.selected_years(polygons, "cls", "years", "id")
    assert lists(tmp2) == {("A", "2018"): ["GI_1", "GI_2"]}
    full = index_tables.full_cover(tmp0, polygons, "id", "pct")
    assert sorted((r["class"], r["year"], r["id"]) for r in full.filter("id is not null").collect()) == [("A", "2015", "GI_1"), ("A", "2018", "GI_1")]
    assert [r["class"] for r in full.filter("id is null").collect()] == ["B"]
    count = {(r["class"], r["year"]): r["pixels"] for r in index_tables.pixel_count(tmp0, polygons, "id", "area").collect()}
    assert count == {("A", "2015"): 2, ("A", "2018"): 2, ("B", "2012"): 10, ("B", "2015"): 10}
    area = {r["class"]: r["area"] for r in index_tables.unique_area(tmp0, polygons, "id", "area").collect()}
    assert area == pytest.approx({"A": 3.49, "B": 10.0})
    assert [r["ids"] for r in index_tables.as_lists(spark.createDataFrame([("A", "1", "GI_2"), ("A", "1", "GI_10")], "class string, year string, id string")).collect()] == [["GI_10", "GI_2"]]
    wide = {r["class"]: r.asDict() for r in index_tables.wide(tmp0, ["2015", "2018"]).collect()}
    assert wide["B"]["2018"] == []


def test_metrics(spark):
    pairs = spark.createDataFrame(list(zip("aaabbc", "aabbba")), "t string, p string").withColumn("k", F.lit(1))
    acc = metrics.accuracy(pairs, ["k"], "t", "p").first()
    assert (acc.n, acc.acc, acc.macro_f1, acc.weighted_f1) == (6, 0.67, 0.49, 0.6)
    per = {r["class"]: (r.precision, r.recall, r.f1, r.n) for r in metrics.class_scores(pairs, ["k"], "t", "p").collect()}
    assert per == {"a": (0.67, 0.67, 0.67, 3), "b": (0.67, 1.0, 0.8, 2), "c": (0.0, 0.0, 0.0, 1)}


def test_year_averages(spark):
    df = spark.createDataFrame([(2020, "Q1", 0.8, 10), (2020, "Q2", 0.6, 20), (2020, "Q3", None, None), (2020, "Q4", None, 30)], "y int, t string, acc double, n int")
    got = metrics.weighted_year_average(df, dict.fromkeys(["Q1", "Q2", "Q3", "Q4"], 0.25), "y", "t", ["acc"], ["n"]).first()
    assert (got.acc, got.n) == (0.7, 15)
    with pytest.raises(ValueError):
        metrics.weighted_year_average(df, {"Q1": 0.5}, "y", "t", ["acc"], ["n"])


def test_raster_algebra(spark):
    df = spark.createDataFrame([(0.05,), (0.0,), (-1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(raster.to_db(F.col("x"))).collect()]
    assert got[0] == pytest.approx(-13.0103, abs=1e-4) and got[1:] == [None, None, None]
    one = spark.createDataFrame([(1000, 3000, 1e-11)], "red int, nir int, vh double")
    r = one.select(raster.ndvi(F.col("red"), F.col("nir")), raster.ratio(F.lit(1.0), F.col("vh"))).first()
    assert r[0] == pytest.approx(0.5, abs=1e-9) and r[1] is None
    v = spark.createDataFrame([(40000.0,), (-40000.0,), (1.9,), (None,)], "v double").select(S.to_int16(F.col("v"))).collect()
    assert [x[0] for x in v] == [32767, -32768, 1, None]
    std = raster.period_stats(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double"), ["k"], "v")
    assert {r.k: r["std"] for r in std.collect()} == {1: pytest.approx(1.527525, abs=1e-6), 2: None}


def test_alignment(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    same = raster.aligned(cells, (0.0, 4.0, 1.0), (0.0, 4.0, 1.0), 4, 4)
    assert {(r.row, r.col): r.value for r in same.collect()} == {(r.row, r.col): r.value for r in cells.collect()}
    half = raster.aligned(cells, (0.0, 4.0, 1.0), (0.5, 3.5, 1.0), 3, 3)
    assert {(r.row, r.col): r.value for r in half.collect()}[(0, 0)] == pytest.approx((0 + 1 + 10 + 11) / 4)
    up = raster.upsampled(cells, 2)
    back = raster.downsampled(up, 2)
    assert sorted(map(tuple, back.select("row", "col", "value").collect())) == sorted(map(tuple, cells.collect()))
    meta = spark.createDataFrame([("a", 0.0, 4.0, 1.0), ("b", 4.0, 4.0, 1.0)], "raster string, x0 double, y0 double, res double")
    tiles = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0)], "raster string, row int, col int, value double")
    assert sorted((r.raster, r.row, r.col) for r in raster.to_global(tiles, meta).collect()) == [("a", 0, 0), ("b", 0, 4)]
    with pytest.raises(ValueError):
        raster.to_global(tiles, meta.withColumn("x0", F.col("x0") * 1.1))


def test_regions(spark):
    picture = ["110", "001", "110"]
    cells = spark.createDataFrame([(r, c, int(v)) for r, line in enumerate(picture) for c, v in enumerate(line)], "row int, col int, value int").filter("value = 1")
    assert grid.regions(cells, corners=True).select("region").distinct().count() == 1
    assert grid.regions(cells, corners=False).select("region").distinct().count() == 3


def test_scalars(spark):
    row = spark.createDataFrame([("2017,2018", "12018", "GI_41687_1", "X", "WD1_plusOW_p80_tmp2_cart_at1__x", "[a, 'b']", "2018, 2019, ..., 2022")], "a string, b string, c string, d string, e string, f string, g string")
    r = row.select(
        S.has_year(F.col("a"), 2018), S.has_year(F.col("b"), 2018), S.polygon_key(F.col("c")), S.polygon_key(F.col("d")), S.run_division(F.col("e")), S.run_attempt(F.col("e")),
        S.list_cell(F.col("f")), S.expand_years(F.col("g")), S.insert_after_tmp(F.col("e"), "split"), S.epsg_code(F.lit("UTM32631")), S.epsg_code(F.lit("RD")), S.fractional_year(F.lit(2020), F.lit(2), 4),
        S.first_known_token(F.lit("a__WD1__b"), ["WD1"]), S.round2(F.lit(0.125)),
    ).first()
    assert list(r) == [True, False, "GI_41687", "X", "WD1", "at1", ["a", "b"], ["2018", "2019", "2020", "2021", "2022"], "WD1_plusOW_p80_tmp2_split_cart_at1__x", "EPSG:32631", "EPSG:28992", 2020.625, "WD1", 0.12]


def test_colours(spark):
    import colorsys

    df = spark.createDataFrame([("#336699",), ("#000000",), ("#ffffff80",), ("#ff8000",)], "c string")
    got = df.withColumn("rgb", S.hex_rgb(F.col("c"))).withColumn("hsv", S.rgb_hsv(F.col("rgb.r"), F.col("rgb.g"), F.col("rgb.b")))
    got = got.withColumn("back", S.hsv_rgb(F.col("hsv.h"), F.col("hsv.s"), F.col("hsv.v"))).withColumn("hex", S.rgb_hex(F.col("back.r"), F.col("back.g"), F.col("back.b")))
    for r in got.collect():
        h, s, v = colorsys.rgb_to_hsv(*r.rgb)
        assert list(r.hsv) == pytest.approx([360 * h, s, v])
        assert r.hex == r.c[:7]


def test_split_takes_more_than_ten_thousand_polygons():
    """A class of small polygons reaches a cap that needs more than 10,000 of them."""
    rows = pd.DataFrame({"class": "x", "year": "2020", "polygon": [f"a{i:05d}" for i in range(10_001)], "row": 0, "col": 0}).assign(id=lambda d: d.polygon + "_0")
    out = split.split_class(rows, split.SplitPlan(cap=10_001, shares=(1.0, 0.0, 0.0)))
    assert (out.split == "train").all()


def test_split_invariants_and_reruns():
    rng = np.random.default_rng(0)
    rows = pd.DataFrame([("A", str(2017 + p % 3), f"GI_{p}_{i}", f"GI_{p}", i // 5, i % 5) for p in range(60) for i in range(int(rng.integers(1, 25)))], columns=["class", "year", "id", "polygon", "row", "col"])
    plan = split.SplitPlan(cap=150, shares=(0.5, 0.3, 0.2), large=9)
    a, b = split.split_class(rows, plan), split.split_class(rows.sample(frac=1, random_state=1), plan)
    assert a.equals(b)
    used = a[a.split != "leftover"]
    assert (used.groupby("polygon")["split"].nunique() == 1).all() and (used.groupby("polygon")["year"].nunique() == 1).all()
    big = rows.groupby("polygon").size()
    assert all(len(g) <= 9 for p, g in used.groupby("polygon") if big[p] > 9)
    for s, share in zip(split.SPLITS, plan.shares):
        assert (used.split == s).sum() >= 150 * share


def test_monthly_coverage_and_rolling(spark):
    days = [(1, f"2020-04-{d:02d}", 1.0, 2.0) for d in range(1, 27)] + [(1, f"2020-06-{d:02d}", 1.0, 2.0) for d in range(1, 31)]
    daily = spark.createDataFrame(days, "station int, date string, p double, e double").withColumn("date", F.to_date("date"))
    got = [tuple(r)[1:] for r in timeseries.monthly_sums(daily, "station", "date", ["p", "e"]).orderBy("month").collect()]
    assert [g[1:] for g in got] == [(None, None), (None, None), (30.0, 60.0)]


def test_logistic_fit_recovers_its_parameters(spark):
    rng = np.random.default_rng(1)
    k, a, xi = -0.15, 20.0, 5.0
    u = rng.random(40_000)
    x = xi + a / k * (1 - ((1 - u) / u) ** k)
    got = timeseries.generalised_logistic(spark.createDataFrame(pd.DataFrame({"g": 1, "x": x})), ["g"], "x").first()
    assert (got["shape"], got["scale"], got["loc"]) == pytest.approx((k, a, xi), rel=0.05)


def test_drought_index_is_standard(spark):
    rng = np.random.default_rng(2)
    rows = [(1, f"{1960 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(rng.gamma(3, 20, 60 * 12) - 40)]
    months = spark.createDataFrame(rows, "station int, month string, water_balance double").withColumn("month", F.to_date("month"))
    index = timeseries.drought_index(months, scales=range(1, 4)).cache()
    for r in timeseries.drought_checks(index).collect():
        assert abs(r["mean"]) < 0.1 and abs(r["std"] - 1) < 0.1 and r["seasonal_bias"] <= 0.1
    assert index.filter("k = 3 and spei is null").count() == 2


def test_survey(spark):
    a = spark.createDataFrame([("2020-01-01",), ("2020-01-01",)], "date string").withColumn("date", F.to_date("date"))
    b = spark.createDataFrame([("2020-01-02",)], "date string").withColumn("date", F.to_date("date"))
    assert sorted(tuple(r)[1:] for r in survey.per_day_of({"a": a, "b": b}).collect()) == [(0, 1), (2, 0)]


def test_tags_and_names(spark):
    meta = spark.createDataFrame([("a", {"CLASS-MAP": '{"1": "bog"}'}), ("b", {"LEGEND": '{"bog": "#00f"}'})], "raster string, tags map<string,string>")
    assert sorted(map(tuple, survey.class_map(survey.with_class_map(meta, {2: "fen"})).collect())) == [("a", 1, "bog"), ("b", 2, "fen")]
    assert [tuple(r) for r in survey.legend(meta).collect()] == [("b", "bog", "#00f")]
    names = spark.createDataFrame([(2, "Dry_Heath"), (1, "dry heath"), (3, None)], "o int, n string")
    assert [tuple(r) for r in survey.first_by_name(names, "n", "n", "o").collect()] == [("dryheath", "dry heath")]


def test_windows():
    assert raster.world_window((100.0, 200.0, 10.0), (105.0, 155.0, 125.0, 195.0)) == ((0, 5), (0, 3))


def test_forest_by_timeframe(spark):
    from fenmark.operators import ml

    rng = np.random.default_rng(7)
    rows = [(t, 2020 + i % 2, float(v), float(w), "a" if v > 0.5 else "b") for t in ("Q1", "Q2") for i, (v, w) in enumerate(rng.random((120, 2)))]
    df = spark.createDataFrame([*rows, ("Q1", 2020, None, 0.5, "a")], "timeframe string, year int, b1 double, b2 double, type string")
    scores = ml.forest_scores(df, df, ["b1", "b2"], "type", "timeframe", "year", trees=5, depth=3).collect()
    assert len(scores) == 4 and all(r.acc > 0.9 for r in scores) and sum(r.n for r in scores) == 240


def test_numbers_over_the_whole_table(spark):
    from fenmark.operators.numbering import numbered

    df = spark.createDataFrame([(int(v),) for v in np.random.default_rng(3).permutation(500)], "v int")
    assert all(r.n == r.v + 1 for r in numbered(df, ["v"], bins=7).collect())
    rows = spark.createDataFrame([(5, 30.0), (3, 10.0), (4, 20.0)], "v int, area double")
    got = index_tables.tidy(rows, ["v"], "OW", {"pct": 100}, "area", 15.0).orderBy("v").collect()
    assert [(r.v, r["index"], r.pct) for r in got] == [(4, "OW_1", 100), (5, "OW_2", 100)]


def test_marks_of_a_split(spark):
    counts = spark.createDataFrame([("a", "1", 0), ("a", "2", 1500), ("b", "1", 7)], "class string, year string, pixels long")
    original = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "class string, year string, id string")
    got = {(r["class"], r.year): r.shown for r in index_tables.split_marks(counts, original).collect()}
    assert got == {("a", "1"): "[-]", ("a", "2"): "999+", ("b", "1"): "7"}


def test_union_wants_equal_columns(spark):
    with pytest.raises(ValueError):
        index_tables.union_strict(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int"))


def test_sampled_pairs(spark):
    points = spark.createDataFrame([(1, 0.5, -0.5, "bog"), (2, 1.5, -0.5, "fen"), (3, 9.0, -9.0, "bog"), (4, 0.5, -1.5, "bog")], "id int, x double, y double, type string")
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 7)], "row int, col int, value int")
    got = metrics.sampled_pairs(points, cells, {"1": "bog", "2": "fen"}, "x", "y", "type", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    assert sorted((r.id, r.y_pred) for r in got.collect()) == [(1, "bog"), (2, "fen")]


def test_stretch_and_grids(spark):
    cells = spark.createDataFrame([(0, c, float(c)) for c in range(101)] + [(1, 0, None)], "row int, col int, value double")
    got = {r.col: r.unit for r in raster.stretch(cells, "value", 0.0, 1.0).filter("row = 0").collect()}
    assert got[0] == 0 and got[100] == 1 and got[50] == pytest.approx(0.5)
    assert raster.stretch(cells, "value").filter("row = 1").first().unit is None
    meta = spark.createDataFrame([("a", "x", 2, 2, 0.0, 0.0, 1.0), ("b", "x", 2, 2, 0.5, 0.0, 1.0), ("c", None, 2, 2, 0.0, 0.0, 1.0)], "raster string, crs string, height int, width int, x0 double, y0 double, res double")
    assert {r.raster: r.same for r in raster.compare_grids(meta, "a").collect()} == {"a": True, "b": False, "c": False}
    assert {r.raster: r.same for r in raster.compare_grids(meta, "a", tol=1.0).collect()}["b"]
