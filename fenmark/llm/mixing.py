"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a hash, form one stream of tokens that is cut into equal blocks. Point k of a
golden-ratio sequence falls into the cumulative targets and so names the source of slot k; the slot's rank within
its source names the block. A source has as many slots as its target has blocks: points beyond those name nothing, and
a source that the drawn points leave short gets its last slots after them. Documents, cut at block borders, join the
slots on (source, block), which gives the words they are taken for and the slot at which the mix reads them first. Ranks and
stream positions come from sums over chunks plus ranks within a chunk, so that no source, however large, is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, positional, written

GOLDEN = (math.sqrt(5) - 1) / 2
MAX_SOURCES = 100_000  # of the per-source table on the driver; more raise an error


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; the excess goes to the others by weight."""
    out, left, open_ = [0.0] * len(sizes), float(total), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        whole = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= math.fsum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _slot_sources(edges: np.ndarray):
    """Names each slot's source: the golden-ratio point's place among the cumulative targets."""

    def run(it):
        for b in it:
            k = b.column("id").to_numpy()
            at = np.searchsorted(edges, np.modf((k + 0.5) * GOLDEN)[0] * edges[-1], side="right")
            yield pa.record_batch({"k": b.column("id"), "m_src": pa.array(np.minimum(at, len(edges) - 1).astype(np.int32))})

    return run


def mix(
    df: DataFrame,
    weight_of: Callable[[int], float] = lambda i: (3.0, 1.0, 2.0)[i % 3],
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 1024,
    seed: int = 17,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, taken, first_slot (the first slot of the schedule that reads from
    the row; null where nothing is taken); plus `row`, a key of the row's content. A block has block_tokens words, the last one of a
    source fewer.

    Source number i by code point (null last) weighs weight_of(i); the sources share `share` times all words, none
    above `cap` (2 at most) times its own. A null text or one without words has size 0 and is never taken. Equal rows get
    stream positions in a fixed order, so reruns agree. Without words all targets are 0; an empty table gives no rows.
    Other columns of df play no part.
    """
    spark = df.sparkSession
    sized = written(
        df.select(F.col(id_col).alias("m_id"), F.col(source).alias("m_source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("m_key"), F.xxhash64(F.col(id_col), F.col(source), F.col(text)).alias("row")),
        "mix-sizes",
    )
    groups = sized.groupBy("m_source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(groups) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    groups.sort(key=lambda g: (g["m_source"] is None, g["m_source"] or ""))
    sizes = [g["s"] for g in groups]
    total = sum(sizes)
    targets = water_fill(sizes, [weight_of(i) for i in range(len(sizes))], share * total, cap)
    table = spark.createDataFrame(
        [(i, g["m_source"], s, t, math.floor(t)) for i, (g, s, t) in enumerate(zip(groups, sizes, targets))],
        "m_src int, m_source string, source_size long, target double, m_stop long",
    )
    # The per-source table has MAX_SOURCES rows at most.
    placed = sized.join(F.broadcast(table), sized["m_source"].eqNullSafe(table["m_source"])).drop(table["m_source"])
    if not total:
        return placed.select(F.col("m_id").alias(id_col), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), "row")
    block = block_tokens

    # As many buckets as a bucket has rows, about: both are sorted and summed in single tasks.
    bits = math.ceil(math.log2(max(1, sum(g["n"] for g in groups))) / 2)
    bucket = F.shiftrightunsigned("m_key", 64 - bits).cast("int") if bits else F.lit(0)
    some = placed.filter("size > 0").withColumn("m_bucket", bucket)
    sums = some.groupBy("m_src", "m_bucket").agg(F.sum("size").alias("m_sum"))
    before = sums.select("m_src", "m_bucket", (F.sum("m_sum").over(Window.partitionBy("m_src").orderBy("m_bucket")) - F.col("m_sum")).alias("m_before"))
    inside = Window.partitionBy("m_src", "m_bucket").orderBy("m_key", "m_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    stream = some.withColumn("m_run", F.sum("size").over(inside)).join(before, ["m_src", "m_bucket"]).withColumn("m_start", F.col("m_before") + F.col("m_run") - F.col("size"))

    slots_n = math.ceil(1.02 * math.fsum(targets) / block) + 64
    chunk = 65_536
    edges = np.cumsum(np.array(targets))
    tasks = max(1, min(4096, slots_n // chunk))
    slots = spark.range(0, slots_n, 1, tasks).mapInArrow(_slot_sources(edges), "k long, m_src int").withColumn("m_chunk", F.expr(f"cast(k div {chunk} as int)"))
    per = slots.groupBy("m_src", "m_chunk").agg(F.count(F.lit(1)).alias("m_n"))
    earlier = per.select("m_src", "m_chunk", (F.sum("m_n").over(Window.partitionBy("m_src").orderBy("m_chunk")) - F.col("m_n")).alias("m_earlier"))
    ranked = slots.withColumn("m_rank", F.row_number().over(Window.partitionBy("m_src", "m_chunk").orderBy("k")))
    ranked = ranked.join(earlier, ["m_src", "m_chunk"]).select("m_src", (F.col("m_earlier") + F.col("m_rank") - 1).alias("m_block"), "k")
    # Every source has as many slots as its target has blocks.
    drawn = per.groupBy("m_src").agg(F.sum("m_n").alias("m_drawn"))
    short = table.select("m_src", F.ceil(F.col("m_stop") / block).alias("m_need")).join(drawn, "m_src", "left").withColumn("m_drawn", F.coalesce("m_drawn", F.lit(0)))
    late = short.filter("m_drawn < m_need").select("m_src", F.explode(F.expr("sequence(m_drawn, m_need - 1)")).alias("m_block"))
    ranked = ranked.union(late.withColumn("k", slots_n + F.col("m_block") * len(groups) + F.col("m_src")))

    # A source's blocks run through its stream and, where its target exceeds its size, through it once more.
    laps = stream.withColumn("m_lap", F.explode(F.array(*[F.lit(i).cast("long") for i in range(math.ceil(cap))])))
    laps = laps.withColumn("m_from", F.col("m_lap") * F.col("source_size") + F.col("m_start")).withColumn("m_to", F.least(F.col("m_from") + F.col("size"), F.col("m_stop"))).filter("m_from < m_to")
    pieces = laps.withColumn("m_block", F.explode(F.expr(f"sequence(m_from div {block}, (m_to - 1) div {block})")))
    words = F.least("m_to", (F.col("m_block") + 1) * block) - F.greatest("m_from", F.col("m_block") * block)
    taken = pieces.select("m_src", "m_block", "m_start", words.alias("m_words")).join(ranked, ["m_src", "m_block"]).groupBy("m_src", "m_start").agg(F.sum("m_words").alias("m_taken"), F.min("k").alias("first_slot"))
    done = stream.join(taken, ["m_src", "m_start"], "left").select(F.col("m_id").alias(id_col), "size", "source_size", "target", F.coalesce("m_taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "row")
    none = placed.filter("size = 0").select(F.col("m_id").alias(id_col), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), "row")
    return done.unionByName(none)


def mixed(df: DataFrame, **options) -> DataFrame:
    """df's rows as the mix repeats them: taken / size copies, rounded (half up); rows without words are left out.

    Equal rows share alike. An empty table gives no rows; df's columns are kept, whatever their names.
    """
    times = mix(df, **options).filter("size > 0").groupBy("row").agg(F.avg(F.col("taken") / F.col("size")).alias("times"))
    mine, names = positional(df)
    key = F.xxhash64(*[F.col(names[options.get(k, d)]) for k, d in (("id_col", "doc_id"), ("source", "source"), ("text", "text"))])
    copies = times.select(F.col("row").alias("mx_key"), F.floor(F.col("times") + 0.5).cast("int").alias("mx_copies")).filter("mx_copies > 0")
    joined = mine.withColumn("mx_row", key).join(copies, F.col("mx_row") == F.col("mx_key")).withColumn("mx_copy", F.explode(F.expr("sequence(1, mx_copies)")))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()])
