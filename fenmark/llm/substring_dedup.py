"""Substring dedup by super-k-mers.

Consecutive windows of `window` words that share a minimiser (the least hash of their runs of `MINI` words) travel as
one packed string to the minimiser's bucket. There all windows are sorted by hash, equal hashes are confirmed byte by
byte, and each window learns the smallest doc_id that holds it. Equal strings of one block of documents are sent once,
so a passage that many documents share costs a string per block. The answers return to the blocks, which remove words.

Blocks and buckets have a fixed size in bytes: their number follows the input.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, mix, text_bytes, window_hash

MINI = 3  # words of a minimiser
LONGEST = 64  # windows in one string
BLOCK_BYTES = 6 << 20  # of text in a block of documents
BUCKET_BYTES = 8 << 20  # of packed strings in a bucket

_RESULT = "id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string"


def _pack(parts: list[np.ndarray], text: bytes = b"") -> bytes:
    heads = [p.tobytes() for p in parts]
    raw = struct.pack(f"<{len(heads) + 1}q", len(heads), *map(len, heads)) + b"".join(heads) + text
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    lens = struct.unpack_from(f"<{n}q", raw, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(lens, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out, raw[at:]


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if w > have else a


class Block:
    """The super-k-mers of a block's documents; equal strings have one number, in order of appearance."""

    def __init__(self, table: pa.Table, window: int):
        order = np.lexsort([np.arange(table.num_rows), table.column("id").fill_null(NULL_ID).to_numpy()])
        table = table.take(pa.array(order))
        self.ids = table.column("id").fill_null(NULL_ID).to_numpy()
        self.null = table.column("id").is_null().to_numpy(zero_copy_only=False)
        self.texts = [b" ".join(t.split()) if t else b"" for t in table.column("body").to_pylist()]
        self.words = w = Words(self.texts)
        k, n = window, w.n - window + 1
        if n <= 0:
            self.s = self.c = self.lid = np.zeros(0, np.int64)
            self.strings, self.mins = [], np.zeros(0, np.uint64)
            return
        of = w.text_of()
        mini = min(MINI, k)
        mins = _sliding_min(window_hash(w.hash, mini), k - mini + 1)
        valid = of[:n] == of[k - 1 :]
        new = np.ones(n, bool)
        new[1:] = ~(valid[1:] & valid[:-1] & (mins[1:] == mins[:-1]))
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(new, at, 0))
        begin = np.flatnonzero((run % LONGEST == 0) & valid)
        # A string ends at the next beginning or at the first window that crosses texts.
        stop = np.flatnonzero((run % LONGEST == 0) | ~valid)
        after = np.append(stop, n)[np.searchsorted(stop, begin, side="right")]
        self.s, self.c = begin, after - begin
        first, last = w.start[begin], w.end[after + k - 2]
        number: dict[bytes, int] = {}
        raw = w.raw
        self.lid = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(first.tolist(), last.tolist())), np.int64, len(begin))
        self.strings = list(number)
        self.mins = np.zeros(len(number), np.uint64)
        self.mins[self.lid] = mins[begin]
        self.doc = of[begin]


def _send(window: int, buckets: int):
    def run(key, table):
        b = Block(table, window)
        out = {"bucket": [], "blk": [], "data": []}
        if len(b.strings):
            low = np.full(len(b.strings), NULL_ID)
            high = np.full(len(b.strings), np.iinfo(np.int64).min)
            np.minimum.at(low, b.lid, b.ids[b.doc])
            np.maximum.at(high, b.lid, b.ids[b.doc])
            to = (mix(b.mins) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for part in np.split(order, cuts):
                out["bucket"].append(int(to[part[0]]))
                out["blk"].append(key[0].as_py())
                out["data"].append(_pack([np.diff(part, prepend=0).astype(np.int32), low[part], high[part] - low[part]], b"\n".join([b.strings[i] for i in part])))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "blk": pa.array(out["blk"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    return run


def smallest(hashes: np.ndarray, values: np.ndarray, same) -> np.ndarray:
    """For each item, the least value of the items equal to it. same(i, j): which pairs of items are truly equal."""
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    pairs = np.flatnonzero(~new)
    split = pairs[~same(order[pairs - 1], order[pairs])] if len(pairs) else pairs
    starts = np.flatnonzero(new)
    low = np.minimum.reduceat(values[order], starts) if len(starts) else values[:0]
    group = np.cumsum(new) - 1
    out = np.empty_like(values)
    out[order] = low[group]
    for g in np.unique(group[split]):  # different windows with one hash: told apart one by one
        items = order[starts[g] : starts[g + 1] if g + 1 < len(starts) else len(order)]
        left = list(items)
        while left:
            eq = same(np.full(len(left), left[0]), np.array(left))
            mine = [x for x, e in zip(left, eq) if e]
            out[mine] = values[mine].min()
            left = [x for x, e in zip(left, eq) if not e]
    return out


def _answer(window: int):
    def run(key, table):
        lids, lows, highs, blks, texts = [], [], [], [], []
        for blk, blob in zip(table.column("blk").to_pylist(), table.column("data").to_pylist()):
            (step, low, span), text = _unpack(blob, ["<i4", "<i8", "<i8"])  # most spans are 0 and pack to nothing
            lids.append(np.cumsum(step)), lows.append(low), highs.append(low + span)
            blks.append(np.full(len(step), blk))
            texts += text.split(b"\n")
        lid, low, high, blk = map(np.concatenate, (lids, lows, highs, blks))
        w = Words(texts)
        of = w.text_of()
        n = w.n - window + 1
        at = np.flatnonzero(of[:n] == of[window - 1 :])
        raw, first, last = w.raw, w.start[at], w.end[at + window - 1]

        def same(i, j):
            size = last - first
            ok = size[i] == size[j]
            k = np.flatnonzero(ok)
            a, b, s = first[i[k]].tolist(), first[j[k]].tolist(), size[i[k]].tolist()
            ok[k] = np.fromiter((raw[x : x + z] == raw[y : y + z] for x, y, z in zip(a, b, s)), bool, len(k))
            return ok

        string = of[at]
        best = smallest(window_hash(w.hash, window)[at], low[string], same)
        told = np.flatnonzero(best < high[string])
        string, best, off = string[told], best[told], (at[told] - w.first[:-1][string[told]]).astype(np.int32)
        order = np.argsort(blk[string], kind="stable")
        cuts = np.flatnonzero(np.diff(blk[string][order])) + 1
        out = {"blk": [], "data": []}
        for part in np.split(order, cuts) if len(order) else []:
            out["blk"].append(int(blk[string[part[0]]]))
            out["data"].append(_pack([lid[string[part]].astype(np.int32), off[part], best[part]]))
        return pa.table({"blk": pa.array(out["blk"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    return run


def _remove(window: int):
    def run(left, right):
        b = Block(left, window)
        w = b.words
        cover = np.zeros(w.n + 1, np.int64)
        if right.num_rows:
            got = [_unpack(x, ["<i4", "<i4", "<i8"])[0] for x in right.column("data").to_pylist()]
            lid, off, best = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(b.lid, kind="stable")
            begin = np.searchsorted(b.lid[order], lid)
            n = np.searchsorted(b.lid[order], lid, side="right") - begin
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            use = order[np.repeat(begin, n) + step]
            hit = np.repeat(best, n) < b.ids[b.doc[use]]
            at = b.s[use[hit]] + np.repeat(off, n)[hit]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover)[: w.n] > 0
        texts, removed, spans = [], [], []
        total = np.concatenate([[0], np.cumsum(gone)])
        for i, text in enumerate(b.texts):
            lo, hi = w.first[i], w.first[i + 1]
            k = int(total[hi] - total[lo])
            removed.append(k)
            if not k:
                texts.append(text)
                spans.append([])
                continue
            mask = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
            words = text.split()
            texts.append(b" ".join([x for x, m in zip(words, mask) if not m]))
        return pa.table(
            {
                "id": pa.array(b.ids, pa.int64(), mask=b.null),
                "n_words": pa.array(np.diff(w.first), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                "kept": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, spans (removed words, first to last from 0) and kept (the other words, joined by one space).

    A word goes if a window that covers it also begins in a row with a smaller id. Windows are judged on the input.
    A null text has no words; null ids come after all others, and neither they nor rows with equal ids remove each
    other's words. Texts shorter than a window keep everything. An empty table gives no rows; other columns play no part.
    """
    total = text_bytes(df, text)
    blocks, buckets = total // BLOCK_BYTES + 1, int(3.3 * total) // BUCKET_BYTES + 1
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("body")).withColumn("blk", F.pmod(F.xxhash64(F.coalesce("id", F.lit(NULL_ID))), F.lit(blocks)))
    sent = docs.groupBy("blk").applyInArrow(_send(window, buckets), "bucket long, blk long, data binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(window), "blk long, data binary")
    out = docs.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_remove(window), _RESULT)
    return out.withColumnRenamed("id", id_col)
