"""What the operators share: the shared folder, written tables, column hygiene and vectorised word blocks."""

from __future__ import annotations

import atexit
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = 2**63 - 1  # a missing doc_id sorts after every real one
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session that names none gets one of its own, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/fenmark-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/fenmark/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := fresh_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again; others go when the driver ends."""
    for t in tables:
        _remove(t.sparkSession, t.written_at)


def with_result(df: DataFrame, **cols) -> DataFrame:
    """df with result columns; an input column of the same name, in whatever case, gives way."""
    taken = {k.lower() for k in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in cols.items()])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., which clash with no operator's own, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()["b"])


# ---------------------------------------------------------------- word blocks

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n + 1:
        m = max(1 << 16, int(2 ** np.ceil(np.log2(n + 2))))
        inv = pow(base, -1, 2**64)
        up, down = np.ones(m, np.uint64), np.ones(m, np.uint64)
        up[1:], down[1:] = _U(base), _U(inv)
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of several texts: byte positions in one buffer, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], hashes: bool = True):
        self.raw = b"\n".join(texts)
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_WHITE[data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        #: The words of text i are first[i] to first[i + 1].
        self.first = np.append(np.searchsorted(self.start, self.text_at), len(self.start))
        self.n = len(self.start)
        if hashes:
            self.hash = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        """A tabulated polynomial of each word's bytes, taken over pieces of the buffer to bound memory."""
        out = np.empty(self.n, np.uint64)
        at = 0
        while at < self.n:
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + (1 << 20), side="right")))
            piece = data[base : self.end[to - 1]]
            up, down = _pow(_P, len(piece) + 1)
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * up[: len(piece)], out=run[1:])
            s, e = self.start[at:to] - base, self.end[at:to] - base
            out[at:to] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _U(_Q))
            at = to
        return out

    def text_of(self) -> np.ndarray:
        """For each word, its text's number."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; positions that cross texts are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _pow(_Q, len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    return mix((run[k:] - run[:n]) * down[:n] + _U(k))


def batches(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to most at most; one that is larger stands alone."""
    out, at, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            out.append((at, i))
            at, total = i, 0
        total += s
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, list]]:
    """Consecutive parts of a text or binary column of about so many bytes: where each begins, and its values."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in batches(sizes, most):
        yield lo, column.slice(lo, hi - lo).to_pylist()


class Memo:
    """Answers for short strings that a worker has met twice in a batch; it starts anew when full."""

    def __init__(self, size: int, chars: int):
        self.size, self.chars, self.known = size, chars, {}

    def answers(self, split: list[list[str]], fresh: Callable[[list[str]], list]) -> dict:
        """What is known or, through `fresh`, found out about every string of a batch."""
        seen: Counter = Counter()
        for parts in split:
            seen.update(parts)
        known = self.known
        new = [s for s in seen if s not in known]
        if not new:
            return known
        got = dict(zip(new, fresh(new)))
        out = {s: known[s] if s in known else got[s] for s in seen}
        again = {s: v for s, v in got.items() if seen[s] > 1 and len(s) <= self.chars}
        if len(known) + len(again) > self.size:
            known.clear()
        if len(again) <= self.size:
            known.update(again)
        return out


# ---------------------------------------------------------------- connected groups


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node that can be reached.

    Each round every node takes the least of itself and its neighbours, then that one's own choice, and links are contracted to the
    nodes chosen, so at least half of the nodes go. Every round is a table in the shared folder. A node with very many
    links costs a partial minimum per task.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    if not edges.head(1):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    now = None
    while edges.head(1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = to = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
        for _ in range(2):
            via = to.select(F.col("node").alias("via"), F.col("label").alias("far"))
            to = to.join(via, F.col("label") == F.col("via")).select("node", F.col("far").alias("label"))
        to = written(to, "labels")
        past = [first, edges]
        if now is None:
            now = to
        else:
            old = now.select(F.col("node").alias("n0"), F.col("label").alias("l0"))
            past.append(now)
            now = written(old.join(to, F.col("l0") == F.col("node"), "left").select(F.col("n0").alias("node"), F.coalesce("label", "l0").alias("label")), "labels")
        a, b = to.select(F.col("node").alias("a"), F.col("label").alias("la")), to.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = written(edges.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        forget(*past, *([to] if to is not now else []))
    forget(edges)
    return now


def more_components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of groups after more links (a, b): only the labels that links join are looked at again."""
    of = lambda s: groups.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    to = components(between).withColumnsRenamed({"node": "from", "label": "to"})
    every = groups.union(to.select(F.col("from").alias("node"), F.col("from").alias("label")).join(groups.select("node"), "node", "left_anti"))
    return written(every.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")), "groups")
