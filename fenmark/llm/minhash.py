"""Near-duplicate documents by SetSketch registers.

A document's register i is the floor of the negative logarithm, to base BASE, of the least of its shingles' i-th
exponential variates: registers of a union are the greater of both, and equal registers are as likely as sets are alike.
Bands of registers propose pairs, a likelihood test on all registers and both set sizes drops what can't be alike, and
the full sets decide.

Documents with equal words are one node. Nodes that share a band key are compared in cells, bounded blocks of a
group's nodes, and a cell returns at most one link for each node, never all pairs; a group larger than a block is
covered by the cells of all its pairs of blocks, so the work on one crowd of near copies grows with the square of its size.

The likelihood test passes over a pair whose similarity reaches the limit with a probability of exp(-DOUBT) or less, 4e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, components, mix, pieces, window_hash, written

BASE, RATE = 1.001, 20.0
BANDS, ROWS = 32, 5  # at a similarity of 0.8 a pair shares no band with probability (1 - 0.8**5)**32 = 3e-6
BLOCK = 2_048  # nodes of one group in a block
PACKED = 512  # a group of at most so many nodes shares a block with others
DOUBT = 12.5  # log-likelihood ratio (five standard deviations) beyond which a pair is not verified
_LOG = math.log(BASE)
_gen = np.random.Generator(np.random.PCG64(20))
_MUL = _gen.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _gen.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _gen.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of 64-bit shingle hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MUL), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * _MUL + _ADD).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / _LOG), 0, 65534).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of registers; equal registers in a band give equal keys."""
    r = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((r * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_GRID = np.linspace(0.0, 0.999, 112)


def could_reach(similarity: float, n: int, others: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Whether sets of n and of others[j] elements may be so alike, given how many of the first's registers are above
    and below the other's: the likelihood of the similarity against that of the best estimate."""
    total = n + others.astype(float)
    u, v = (n / total)[:, None], (others / total)[:, None]
    equal = (BANDS * ROWS - above - below)[:, None]

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / _LOG
        more, less = p(u - v * j), p(v - u * j)
        return above[:, None] * np.log(more) + below[:, None] * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-12, 1))

    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    each = log_likelihood(j)
    best = each.max(axis=1)
    at = log_likelihood(np.minimum(np.full((len(others), 1), similarity), np.minimum(u / v, v / u)))[:, 0]
    return (j[np.arange(len(j)), each.argmax(axis=1)] >= similarity) | (best - at <= DOUBT)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Of each text: its lower-cased words joined by one space, and the sorted distinct hashes of its shingles."""
    clean = [b" ".join(t.lower().split()) for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in batches([len(c) for c in clean], 2 << 20):
        w = Words(clean[lo:hi])
        h = window_hash(w.hash, k)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            else:
                out.append(window_hash(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return clean, out


def shingle_set(clean: bytes, k: int) -> frozenset[bytes]:
    w = clean.split(b" ") if clean else []
    return frozenset([b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([clean] if w else []))


def _sketch(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, bodies in pieces(b.column("mh_body"), 2 << 20):
                clean, sets = shingle_hashes([t or b"" for t in bodies], k)
                keys = [band_keys(registers(s))[0].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.record_batch(
                    {
                        "mh_id": b.column("mh_id").slice(lo, len(bodies)),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "mh_digest": pa.array([hashlib.blake2b(c, digest_size=16).digest() if c else None for c in clean], pa.binary()),
                        "mh_keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return run


class Cell:
    """The exact comparison of a cell's nodes."""

    def __init__(self, texts: list[bytes], k: int, similarity_pct: int):
        self.clean, self.hashes = shingle_hashes(texts, k)
        self.regs = np.array([registers(h) for h in self.hashes]).reshape(len(texts), BANDS * ROWS)
        self.keys = band_keys(self.regs)
        self.k, self.pct = k, similarity_pct
        self.root = np.arange(len(texts))
        number: dict[bytes, int] = {}
        self.ids = [np.fromiter((number.setdefault(s, len(number)) for s in shingle_set(c, k)), np.int64) for c in self.clean]
        self.size = np.array([len(i) for i in self.ids], np.int64)
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), self.size)
        order = np.argsort(flat, kind="stable")
        self.holders, self.begin = owner[order], np.searchsorted(flat[order], np.arange(len(number) + 1))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def flat(self) -> None:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shingles that node i shares with each of the others."""
        spans = self.begin[self.ids[i]], self.begin[self.ids[i] + 1]
        if (spans[1] - spans[0]).sum() < 40 * len(others) * 10:
            return np.bincount(np.concatenate([self.holders[a:b] for a, b in zip(*spans)]), minlength=len(self.root))[others]
        mine = set(self.ids[i].tolist())
        return np.array([len(mine.intersection(self.ids[j].tolist())) for j in others])

    def link(self, i: int, others: np.ndarray) -> None:
        """Joins node i with those of the others that are alike, leaving out what is joined already."""
        self.flat()
        o = others[self.root[others] != self.root[i]]
        o = o[100 * np.minimum(self.size[o], self.size[i]) >= self.pct * np.maximum(self.size[o], self.size[i])]
        o = o[(self.keys[o] == self.keys[i]).any(axis=1)] if len(o) else o
        if not len(o):
            return
        above, below = (self.regs[i] > self.regs[o]).sum(axis=1), (self.regs[i] < self.regs[o]).sum(axis=1)
        o = o[could_reach(self.pct / 100, int(self.size[i]), self.size[o], above, below)]
        if not len(o):
            return
        both = self.common(i, o)
        for j in o[100 * both >= self.pct * (self.size[i] + self.size[o] - both)]:
            a, b = self.find(i), self.find(int(j))
            self.root[max(a, b)] = min(a, b)


def _verify(k: int, pct: int):
    def run(key, table):
        lo, hi = key[0].as_py(), key[1].as_py()
        order = np.argsort(table.column("mh_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, block = table.column("mh_id").to_numpy(), table.column("mh_block").to_numpy()
        c = Cell(table.column("mh_body").to_pylist(), k, pct)
        for i in range(len(ids)):
            if lo == hi:
                c.link(i, np.arange(i + 1, len(ids)))
            elif block[i] == lo:
                c.link(i, np.flatnonzero(block == hi))
        c.flat()
        far = np.flatnonzero(ids[c.root] != ids)
        return pa.table({"a": pa.array(ids[far], pa.int64()), "b": pa.array(ids[c.root[far]], pa.int64())})

    return run


def near_duplicates(df: DataFrame, shingle: int = 4, similarity_pct: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the least id reachable by links) and kept (id = component_id) of each row of df.

    Texts link if 100 * intersection >= similarity_pct * union of their sets of lower-cased (A-Z) word shingles; a
    text with fewer words has its whole sequence as one. A text that is null or has no words has an empty set and links with
    nothing; so does a row without an id, whose component_id is null and which is kept. Rows with equal ids are one
    node: a link of any counts for all. An empty table gives no rows; other columns play no part.
    """
    docs = df.select(F.col(id_col).cast("long").alias("mh_id"), F.col(text).cast("binary").alias("mh_body"))
    sketches = written(docs.mapInArrow(_sketch(shingle), "mh_id long, n_shingles long, mh_digest binary, mh_keys array<long>"), "sketches")
    some = sketches.filter("mh_id is not null and n_shingles > 0")
    nodes = written(some.groupBy("mh_digest").agg(F.min("mh_id").alias("mh_node"), F.first("mh_keys").alias("mh_keys")), "nodes")
    bands = nodes.select("mh_node", F.explode("mh_keys").alias("mh_key"))
    shared = bands.groupBy("mh_key").agg(F.count(F.lit(1)).alias("n"), F.min("mh_node").alias("mh_pivot")).filter("n > 1").drop("n")
    members = written(bands.join(shared, "mh_key"), "members")

    home = members.groupBy("mh_node").agg(F.min("mh_pivot").alias("mh_home"))
    home = written(home, "homes")
    sizes = home.groupBy("mh_home").agg(F.count(F.lit(1)).alias("n"))
    packs = home.count() // 1024 + 1
    part = F.pmod(F.xxhash64("mh_node", F.lit(1)), F.ceil(F.col("n") / BLOCK))
    block = F.when(F.col("n") <= PACKED, F.pmod(F.xxhash64("mh_home"), F.lit(packs))).otherwise(F.xxhash64("mh_home", part))
    blocks = home.join(sizes, "mh_home").select("mh_node", block.alias("mh_block"))
    placed = written(members.select("mh_key", "mh_node").join(blocks, "mh_node"), "placed")
    # Blocks of a key: a group of g nodes has g / BLOCK of them, most have one.
    met = placed.groupBy("mh_key").agg(F.collect_set("mh_block").alias("mh_met"))
    other = F.explode("mh_met").alias("mh_other")
    cells = placed.join(met, "mh_key").select("mh_node", "mh_block", other).select("mh_node", "mh_block", F.least("mh_block", "mh_other").alias("lo"), F.greatest("mh_block", "mh_other").alias("hi")).distinct()
    cells = cells.withColumnRenamed("mh_node", "mh_id")
    links = docs.filter("mh_id is not null").join(cells, "mh_id").groupBy("lo", "hi").applyInArrow(_verify(shingle, similarity_pct), "a long, b long")
    groups = components(links)

    of_digest = nodes.select(F.col("mh_digest"), "mh_node")
    out = sketches.join(of_digest, "mh_digest", "left").join(groups, F.col("mh_node") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "mh_node")).otherwise(F.col("mh_id"))
    return out.select(F.col("mh_id").alias(id_col), "n_shingles", F.when(F.col("mh_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
