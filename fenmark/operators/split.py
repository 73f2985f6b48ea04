"""Train, validation and test split of index tables: whole polygons, each in one split and one year, capped per class.

A polygon's offer is found by itself: all its pixels of a year, or a connected patch of a large one. Choices within a class
depend on each other, so a class's offers are worked through in turn, but only as many of them as the cap can use: pixels are
joined to what is chosen. The result is reproducible: offers are taken in the order of a seeded digest, ties by a seeded generator.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import polygon_key

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitPlan:
    cap: int  # pixels of a class over all splits
    shares: tuple[float, float, float] = (0.7, 0.3, 0.0)
    large: int = 36  # pixels from which a polygon gives only a connected patch of so many
    seed: int = 42


def _patch(cells: np.ndarray, start: int, size: int) -> list[int] | None:
    """Up to size cells grown from start breadth first, edge neighbours before corner ones; null for a lone cell."""
    at = {(int(r), int(c)): i for i, (r, c) in enumerate(cells)}
    seen, queue = {start}, [start]
    for i in queue:
        if len(seen) >= size:
            break
        r, c = map(int, cells[i])
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)):
            j = at.get((r + dr, c + dc))
            if j is not None and j not in seen and len(seen) < size:
                seen.add(j)
                queue.append(j)
    return queue[:size] if len(queue) > 1 or len(cells) == 1 else None


def _digest(seed: int, year: str, polygon: str) -> str:
    return hashlib.md5(f"{seed}|{year}|{polygon}".encode()).hexdigest()


def patch_of(pixels: pd.DataFrame, plan: SplitPlan) -> pd.DataFrame:
    """The pixels that a large polygon offers in a year: a patch around one of them, or none if that one stands alone."""
    pixels = pixels.sort_values("id", kind="stable").reset_index(drop=True)
    start = int(_digest(plan.seed, pixels["year"].iloc[0], pixels["polygon"].iloc[0])[:8], 16) % len(pixels)
    patch = _patch(pixels[["row", "col"]].to_numpy(), start, plan.large)
    return pixels.iloc[patch if patch is not None else []]


def _patches(pixels: DataFrame, plan: SplitPlan) -> DataFrame:
    """class, year, polygon and the ids of the pixels that patch_of offers; a polygon's pixels of a year are gathered."""

    def ids_of(year: pd.Series, polygon: pd.Series, ids: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
        out = []
        for y, p, i, r, c in zip(year, polygon, ids, rows, cols):
            patch = _patch(np.column_stack([r, c]), int(_digest(plan.seed, y, p)[:8], 16) % len(i), plan.large)
            out.append([i[k] for k in patch or []])
        return pd.Series(out, dtype=object)

    keys = ["class", "year", "polygon"]
    own = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "row", "col"))).alias("px"))
    # Otherwise a filter on the result would run it a second time.
    ids = F.pandas_udf(ids_of, "array<string>").asNondeterministic()
    return own.select(*keys, ids("year", "polygon", "px.id", "px.row", "px.col").alias("ids"))


def offers_needed(plan: SplitPlan) -> int:
    """Offers of a year that a class can use up: each that is taken gives a pixel at least, and each that is passed over was taken for another year."""
    return 2 * (int(plan.cap) + len(SPLITS))


def choose(offers: pd.DataFrame, plan: SplitPlan) -> pd.DataFrame:
    """The offers (class, year, polygon, n, place: their order in a year) that are taken, with their split.

    The split that lacks most is served, from a drawn year's next polygon; a polygon serves one split and one year.
    """
    rng = np.random.default_rng(plan.seed)
    target = {s: plan.cap * p for s, p in zip(SPLITS, plan.shares)}
    got = dict.fromkeys(SPLITS, 0)
    queues = {y: list(g.sort_values("place").itertuples(index=False))[::-1] for y, g in sorted(offers.groupby("year"))}
    used: set[str] = set()
    out = []
    while True:
        need = {s: target[s] - got[s] for s in SPLITS if target[s] - got[s] > 0}
        for q in queues.values():
            while q and q[-1].polygon in used:
                q.pop()
        years = [y for y, q in queues.items() if q]
        if not need or not years:
            break
        most = max(need.values())
        ties = [s for s in SPLITS if need.get(s) == most]
        s = ties[int(rng.integers(len(ties)))]
        offer = queues[years[int(rng.integers(len(years)))]].pop()
        used.add(offer.polygon)
        got[s] += offer.n
        out.append((*offer[:3], s))
    return pd.DataFrame(out, columns=["class", "year", "polygon", "split"])


def split_class(rows: pd.DataFrame, plan: SplitPlan) -> pd.DataFrame:
    """rows of one class (class, year, id, polygon, row, col) with split: train, val, test or leftover; in memory, as train_val_split."""
    rows = rows.sort_values(["year", "polygon", "id"], kind="stable").reset_index(drop=True)
    size_all = rows.groupby("polygon")["id"].size()  # over all years
    keys = ["class", "year", "polygon"]
    large = rows["polygon"].map(size_all) > plan.large
    patches = [patch_of(g, plan) for _, g in rows[large].groupby(keys)]
    offered = pd.concat([rows[~large], *patches])
    offers = offered.groupby(keys).size().rename("n").reset_index()
    offers["place"] = [_digest(plan.seed, y, p) + p for y, p in zip(offers["year"], offers["polygon"])]
    taken = offered.merge(choose(offers, plan), on=keys)[["year", "id", "split"]]
    out = rows.merge(taken, on=["year", "id"], how="left")
    return out.assign(split=out["split"].fillna("leftover"))


def train_val_split(index: DataFrame, cells: DataFrame, plan: SplitPlan) -> DataFrame:
    """index (class, year, id) with polygon, row, col and split. cells: id, row, col of each pixel.

    A large polygon's pixels of one year are one group, and so are the offers of a class that its cap can use. An empty
    table gives no rows; an id that occurs twice in a class's year counts twice.
    """
    # Both sides have a row for each pixel, however small the tables are that they were made from, so neither is ever broadcast.
    rows = index.hint("merge").join(cells.select("id", "row", "col"), "id").withColumn("polygon", polygon_key(F.col("id"))).select("class", "year", "id", "polygon", F.col("row").cast("long"), F.col("col").cast("long"))
    keys = ["class", "year", "polygon"]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sized = per.withColumn("all", F.sum("n").over(Window.partitionBy("class", "polygon")))  # a row for each year
    large = rows.join(sized.filter(F.col("all") > plan.large).select(*keys), keys, "left_semi")
    offers = sized.filter(F.col("all") <= plan.large).select(*keys, "n").union(_patches(large, plan).select(*keys, F.size("ids").cast("long").alias("n")).filter("n > 0"))
    digest = F.concat(F.md5(F.concat_ws("|", F.lit(str(plan.seed)), "year", "polygon")), "polygon")
    place = F.row_number().over(Window.partitionBy("class", "year").orderBy("place"))
    few = offers.withColumn("place", digest).withColumn("nth", place).filter(F.col("nth") <= offers_needed(plan)).select(*keys, "n", "place")
    chosen = few.groupBy("class").applyInPandas(lambda o: choose(o, plan), "class string, year string, polygon string, split string")
    picked = sized.join(chosen, keys).select(*keys, "all", "split")
    whole = rows.join(picked, keys, "left")
    # A patch depends on its polygon alone, so those that are taken are found again.
    patches = _patches(large.join(picked.select(*keys), keys, "left_semi"), plan)
    part = patches.select(F.col("class").alias("p_class"), F.col("year").alias("p_year"), F.explode("ids").alias("p_id")).distinct()
    whole = whole.join(part, (F.col("class") == F.col("p_class")) & (F.col("year") == F.col("p_year")) & (F.col("id") == F.col("p_id")), "left")
    taken = (F.col("all") <= plan.large) | F.col("p_id").isNotNull()
    return whole.select("class", "year", "id", "polygon", "row", "col", F.coalesce(F.when(taken, F.col("split")), F.lit("leftover")).alias("split"))


def split_summary(split: DataFrame) -> DataFrame:
    """class, split, pixels, polygons and years."""
    return split.groupBy("class", "split").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("polygon").alias("polygons"), F.count_distinct("year").alias("years"))


def split_faults(split: DataFrame, large: int) -> DataFrame:
    """(fault, n): polygons in several splits or years, and polygons that give more than a patch; n must be 0."""
    # The split's plan is long, and the driver holds it as often as it is read: all counts come from one reading.
    taken = F.col("split") != "leftover"
    rows = split.groupBy("class", "polygon", "split", "year").agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("class", "polygon").agg(F.count_distinct(F.when(taken, F.col("split"))).alias("s"), F.count_distinct(F.when(taken, F.col("year"))).alias("y"), F.sum(F.when(taken, F.col("n"))).alias("n"), F.sum("n").alias("all"))
    both = per.filter("n > 0 and class is not null and polygon is not null")
    return both.agg(F.count(F.when(F.col("s") > 1, 1)).alias("several_splits"), F.count(F.when(F.col("y") > 1, 1)).alias("several_years"), F.count(F.when((F.col("all") > large) & (F.col("n") > large), 1)).alias("over_patch"))
