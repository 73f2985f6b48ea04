"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard.

Equal vectors are one node. A shard's nodes are inserted in batches: greedy searches from the shard's medoid propose
neighbours, pruning keeps a neighbour only if no kept one is nearer to it by the factor ALPHA, and reverse edges are pruned
alike. Queries, in blocks, go through every shard by beam search; the shards' best are merged and scored in double precision.

Largest inner product becomes least distance by one more coordinate, which lifts all of a shard's vectors to its largest norm.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DEGREE, ALPHA = 40, 1.2
BUILD_BEAM, BEAM = 64, 128
SHARD = 12_288  # nodes of a shard
BLOCK = 2_048  # queries of a block
BATCH = 256


class Graph:
    """ids in ascending order, their vectors as given, and the edges; walks go by the vectors in single precision."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.ids, self.vectors, self.edges, self.entry = ids, vectors, edges, entry
        self.short = vectors.astype(np.float32, copy=False)

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 9) -> Graph:
        g = Graph(ids, vectors)
        n = len(ids)
        norm = (g.short.astype(np.float64) ** 2).sum(axis=1)
        g.lifted = np.column_stack([g.short, np.sqrt(np.maximum(norm.max() - norm, 0))]).astype(np.float32)
        g.square = (g.lifted**2).sum(axis=1)
        g.edges = np.full((n, DEGREE), -1, np.int32)
        g.entry = int(np.argmin(g.square - 2 * g.lifted @ g.lifted.mean(axis=0)))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[g.entry], order[order != g.entry]])
        done = min(n, BATCH)
        first = order[:done]
        g._insert(first, np.broadcast_to(first, (done, done)))
        while done < n:
            batch = order[done : done + min(BATCH, max(32, done // 4))]
            beam, seen = g._walk(g.lifted[batch], BUILD_BEAM)
            g._insert(batch, np.concatenate([beam, seen], axis=1))
            done += len(batch)
        g._connect()
        return g

    def _insert(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        self.edges[nodes] = self._prune(nodes, candidates)
        to = self.edges[nodes]
        at, col = np.nonzero(to >= 0)
        target, source = to[at, col], nodes[at]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        counts = np.diff(np.append(starts, len(target)))
        width = min(int(counts.max()) if len(counts) else 0, 2 * DEGREE)
        back = np.full((len(starts), width), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        fits = place < width
        back[np.repeat(np.arange(len(starts)), counts)[fits], place[fits]] = source[fits]
        hubs = target[starts]
        both = np.concatenate([self.edges[hubs], back], axis=1)
        short = (both >= 0).sum(axis=1) <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        dup = (both[:, None, :DEGREE] == both[:, DEGREE:, None]).any(axis=(1, 2)) if width else np.zeros(len(hubs), bool)
        self.edges[hubs[short & ~dup]] = packed[short & ~dup][:, :DEGREE]
        rest = np.flatnonzero(~short | dup)
        for i in range(0, len(rest), BATCH):
            r = rest[i : i + BATCH]
            self.edges[hubs[r]] = self._prune(hubs[r], both[r])

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for i in range(0, len(nodes), BATCH):
            p, c = nodes[i : i + BATCH], np.sort(candidates[i : i + BATCH], axis=1)
            bad = (c < 0) | (c == p[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            v = self.lifted[c]
            d = self.square[c] + self.square[p][:, None] - 2 * np.einsum("bcd,bd->bc", v, self.lifted[p])
            d[bad] = np.inf
            by = np.argsort(d, axis=1, kind="stable")[:, : 3 * DEGREE + BUILD_BEAM]
            c, d = np.take_along_axis(c, by, axis=1), np.take_along_axis(d, by, axis=1)
            v, s = self.lifted[c], self.square[c]
            apart = s[:, :, None] + s[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
            alive, rows = np.isfinite(d), np.arange(len(p))
            for k in range(DEGREE):
                pick = alive.argmax(axis=1)
                ok = alive[rows, pick]
                if not ok.any():
                    break
                out[i : i + len(p), k] = np.where(ok, c[rows, pick], -1)
                alive &= ~((ALPHA**2 * apart[rows, pick] <= d) & ok[:, None])
                alive[rows, pick] = False
        return out

    def _walk(self, q: np.ndarray, beam: int, lifted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The nodes nearest to each query, nearest first, and those whose edges were followed; -1: none."""
        b, n = len(q), len(self.ids)
        v = self.lifted if lifted else self.short
        rows = np.arange(b)
        cost = lambda at, ids: (self.square[ids] if lifted else 0) - (2 if lifted else 1) * np.einsum("bkd,bd->bk", v[ids], q[at])
        met = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        spent = np.ones((b, beam), bool)
        ids[:, 0], spent[:, 0], met[:, self.entry] = self.entry, False, True
        dist[:, 0] = cost(rows, np.full((b, 1), self.entry))[:, 0]
        seen = []
        while True:
            at = np.flatnonzero(~spent.all(axis=1))
            if not len(at):
                break
            pick = (~spent[at]).argmax(axis=1)
            spent[at, pick] = True
            node = ids[at, pick]
            col = np.full(b, -1, np.int32)
            col[at] = node
            seen.append(col)
            near = self.edges[node]
            new = (near >= 0) & ~met[at[:, None], near]
            near = np.where(new, near, 0)
            d = np.where(new, cost(at, near), np.inf)
            r, c = np.nonzero(new)
            met[at[r], near[r, c]] = True
            all_d = np.concatenate([dist[at], d], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[at] = np.take_along_axis(all_d, keep, axis=1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], np.where(new, near, -1)], axis=1), keep, axis=1)
            spent[at] = np.take_along_axis(np.concatenate([spent[at], ~new], axis=1), keep, axis=1)
        ids[~np.isfinite(dist)] = -1
        return ids, np.array(seen).T

    def _connect(self) -> None:
        """Gives every node that the entry doesn't reach an edge from one that it does."""
        n = len(self.ids)
        reach = np.zeros(n, bool)

        def spread(front: np.ndarray) -> None:
            while len(front):
                reach[front] = True
                to = np.unique(self.edges[front])
                front = to[(to >= 0) & ~reach[np.maximum(to, 0)]]

        spread(np.array([self.entry]))
        while not reach.all():
            u = int(np.flatnonzero(~reach)[0])
            near = self._walk(self.lifted[[u]], BUILD_BEAM)[0][0]
            near = np.concatenate([near[near >= 0], np.flatnonzero(reach)])
            free = near[(self.edges[near] < 0).any(axis=1)]
            if len(free):
                at, k = free[0], int((self.edges[free[0]] < 0).argmax())
            else:  # all lists are full: one more column
                self.edges = np.column_stack([self.edges, np.full(n, -1, np.int32)])
                at, k = near[0], self.edges.shape[1] - 1
            self.edges[at, k] = u
            spread(np.array([u]))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the row numbers of its k nearest found (-1: none) and their inner products, ties by id."""
        found, scores = [], []
        q32 = q.astype(np.float32)
        for i in range(0, len(q), BATCH):
            ids = self._walk(q32[i : i + BATCH], max(BEAM, 2 * k), lifted=False)[0]
            s = np.einsum("bkd,bd->bk", self.vectors[np.maximum(ids, 0)].astype(np.float64), q[i : i + BATCH].astype(np.float64))
            s[ids < 0] = -np.inf
            by = np.lexsort([ids, -s], axis=1)[:, :k]  # row numbers are in the order of ids
            found.append(np.take_along_axis(ids, by, axis=1))
            scores.append(np.take_along_axis(s, by, axis=1))
        return np.concatenate(found), np.concatenate(scores)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, edges=self.edges, entry=self.entry)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as z:
            return Graph(z["ids"], z["vectors"], z["edges"], int(z["entry"]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _build(key, table):
    order = np.argsort(table.column("node").to_numpy())
    table = table.take(pa.array(order))
    g = Graph.build(table.column("node").to_numpy(), _matrix(table.column("v")))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "graph": pa.array([g.dump()], pa.binary())})


def _search(k: int):
    def run(left, right):
        out = {"query_id": [], "node": [], "score": []}
        if left.num_rows and right.num_rows:
            q, ids = _matrix(right.column("q")), right.column("query_id").to_numpy()
            for raw in left.column("graph").to_pylist():
                g = Graph.load(raw)
                at, score = g.search(q, k)
                ok = at >= 0
                out["query_id"].append(np.repeat(ids, ok.sum(axis=1)))
                out["node"].append(g.ids[at[ok]])
                out["score"].append(score[ok])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query_id": join(out["query_id"], pa.int64()), "node": join(out["node"], pa.int64()), "score": join(out["score"], pa.float64())})

    return run


def usable(df: DataFrame, id_col: str, vector: str, length: int | None = None) -> DataFrame:
    """id and v of rows that take part: an id, and a vector of the given length (if one is given), not zero, of finite numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return fine if length is None else fine.filter(F.size("v") == length).distinct()


def length_of(df: DataFrame, id_col: str, vector: str) -> int:
    """The commonest length of the vectors that can take part; of equally common ones the greatest."""
    most = usable(df, id_col, vector).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return most["n"] if most else 0


def index(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, length: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(graphs, members, shards): one graph for each shard from 0 on, the ids of each node's equal vectors (node: the least of
    them), and the number of shards."""
    rows = written(usable(df, id_col, vector, length_of(df, id_col, vector) if length is None else length), "vectors")
    nodes = written(rows.groupBy("v").agg(F.min("id").alias("node")), "vector-nodes")
    shards = max(1, -(-nodes.count() // shard))
    graphs = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards))).groupBy("shard").applyInArrow(_build, "shard long, graph binary")
    members = rows.join(nodes, "v").select("node", "id")
    return written(graphs, "graphs"), written(members, "vector-members"), shards


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest found among the other ids of df.

    Rows without an id, and vectors that are null, empty, zero, not finite, or of another length than most, take no
    part, as query or candidate. Equal scores go by the smaller id; equal rows count once. With fewer candidates than k
    all are returned; an empty table gives no rows.
    """
    length = length_of(df, id_col, vector)  # of the index's vectors, and so of the queries that it can answer
    graphs, members, shards = index(df, id_col, vector, shard, length)
    asked = usable(queries, id_col, vector, length)
    asked = written(asked.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q")), "queries")
    blocks = -(-asked.count() // BLOCK)
    if not blocks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    found = each.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_search(k + 1), "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    some = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    # Of a node's equal vectors the k + 1 of least id are enough.
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
    out = some.join(few, "node").filter("id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
