"""SentencePiece encoding and decoding by suffix-array matching.

Texts fall apart where no piece can reach across (before a space mark that follows another character). The distinct
stretches of a batch are concatenated and their suffixes sorted to the longest piece's depth; a binary search over the
pieces' prefixes, level by level, gives every piece's range of occurrences. These edges, sorted by position, are
relaxed: for BPE models the best-scored edge over two neighbouring symbols is taken first (the leftmost of equals), for unigram
models the best sum of scores wins. Characters that no piece covers fall back to bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, pieces, positional

MARK = "▁"
BATCH_BYTES = 4 << 20  # of text whose new stretches are indexed together
INDEX_CHARS = 1 << 17  # characters of new stretches in one index
MEMO, MEMO_CHARS = 300_000, 40  # stretches that a worker remembers, and the longest of them
LONG = 64  # longer stretches are relaxed with a heap
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int32).max


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: numbers, bytes or floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", raw[at : at + n])[0]
            at += n


class Model:
    """Pieces, scores and kinds of a model file, and its normalisation."""

    fixed: re.Pattern | None = None

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.unigram, self.fallback = True, False
        self.prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        for n, v in _fields(raw):
            if n == 1:
                got = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(v))
                self.pieces.append(got[1].decode())
                self.scores.append(got[2])
                self.kinds.append(got[3])
            elif n == 2:
                got = dict(_fields(v))
                self.unigram, self.fallback = got.get(3, 1) == 1, bool(got.get(35, 0))
            elif n == 3:
                got = dict(_fields(v))
                charsmap = got.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(got.get(i, 1)) for i in (3, 4, 5))
        if charsmap or not self.escape or UNUSED in self.kinds or self.unigram and USER in self.kinds:
            raise ValueError("models with character maps, plain spaces, unused pieces, or sums over pieces of the user aren't handled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.known = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        #: Pieces of the user are taken as they stand, the longest first; merges don't reach across them.
        self.user = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == USER}
        self.fixed = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        self.longest = max(map(len, self.known))
        self.cut = all(MARK not in p.lstrip(MARK) for p in self.known)
        #: Pieces in the order in which BPE prefers them.
        order = sorted(self.known.values(), key=lambda i: -self.scores[i])
        self.rank = np.full(len(self.pieces), _NONE, np.int32)
        place, last = -1, None
        for i in order:  # equally scored pieces share a rank
            if self.scores[i] != last:
                place, last = place + 1, self.scores[i]
            self.rank[i] = place
        self.levels = self._trie()
        self.text = [self._text(i) for i in range(len(self.pieces))]

    def _trie(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level the distinct prefixes of the pieces: parent, last character, and piece (-1: none)."""
        levels, number = [], {"": 0}
        for n in range(1, self.longest + 1):
            own = {p: i for i, p in enumerate(sorted({p[:n] for p in self.known if len(p) >= n}))}
            levels.append((np.array([number[p[:-1]] for p in own]), np.array([ord(p[-1]) for p in own], np.uint32), np.array([self.known.get(p, -1) for p in own])))
            number = own
        return levels

    def _text(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def stretches(self, text: str) -> list[str]:
        """The parts of a text that can be encoded apart."""
        parts = self._cut(text)
        return parts if self.fixed is None else [x for p in parts for x in self.fixed.split(p) if x]

    def _cut(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub("  +", " ", text.strip(" "))
        if not text:
            return []
        if not self.cut:
            return [(MARK if self.prefix else "") + text.replace(" ", MARK)]
        if self.prefix and MARK not in text:
            parts = text.split(" ")
            if "" not in parts:
                return [MARK + p for p in parts]
        return re.split(f"(?<=[^{MARK}])(?={MARK})", (MARK if self.prefix else "") + text.replace(" ", MARK))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the text from there on, as far as depth characters at least."""
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.uint64) + np.uint64(1)
    bits = int(rank.max()).bit_length()
    h = max(1, min(depth, 63 // bits))  # so many characters fit into one number
    key = np.zeros(len(codes), np.uint64)
    for i in range(h):
        key <<= np.uint64(bits)
        key[: len(key) - i] |= rank[i:]
    while h < depth:
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        key = rank * (len(rank) + 1)
        key[:-h] += rank[h:]
        h *= 2
    return np.argsort(key, kind="stable")


def occurrences(codes: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges sorted by position: start, length and piece of every occurrence of every piece."""
    order = suffix_order(codes, m.longest)
    padded = np.append(codes, np.zeros(m.longest, np.uint32))
    lo, hi = np.array([0]), np.array([len(order)])
    starts, lengths, found = [], [], []

    def bound(first: np.ndarray, last: np.ndarray, char: np.ndarray, depth: int, after: bool) -> np.ndarray:
        a, b = first.copy(), last.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) // 2
            c = padded[order[mid] + depth]
            right = c <= char[open_] if after else c < char[open_]
            a[open_] = np.where(right, mid + 1, a[open_])
            b[open_] = np.where(right, b[open_], mid)
        return a

    for depth, (parent, char, piece) in enumerate(m.levels):
        first, last = lo[parent], hi[parent]
        lo, hi = bound(first, last, char, depth, False), bound(first, last, char, depth, True)
        some = np.flatnonzero((piece >= 0) & (hi > lo))
        n = hi[some] - lo[some]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts.append(order[np.repeat(lo[some], n) + step])
        lengths.append(np.full(len(step), depth + 1))
        found.append(np.repeat(piece[some], n))
    start, length, piece = map(np.concatenate, (starts, lengths, found))
    by = np.argsort(start, kind="stable")
    return start[by], length[by], piece[by]


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        self.m, self.memo = Model(path), Memo(memo, MEMO_CHARS)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""

        def fresh(new: list[str]) -> list[bytes]:
            return [v for lo, hi in batches([len(s) + 1 for s in new], INDEX_CHARS) for v in self.relaxed(new[lo:hi])]

        split = [self.m.stretches(t) for t in texts]
        own = self.memo.answers(split, fresh)
        return [b"".join(map(own.__getitem__, parts)) for parts in split]

    def relaxed(self, parts: list[str]) -> list[bytes]:
        """The ids of each distinct stretch."""
        m = self.m
        if m.fixed is not None and any(p in m.user for p in parts):
            others = [p for p in parts if p not in m.user]
            own = dict(zip(others, self.relaxed(others))) if others else {}
            return [own[p] if p in own else np.array([m.user[p]], "<i4").tobytes() for p in parts]
        codes = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        start, length, piece = occurrences(codes, m)
        if m.unigram:
            symbols = [self._best_sum(int(f), int(n), start, length, piece) for f, n in zip(first, lens)]
            return [self._ids(parts[i], [(a - int(first[i]), b - int(first[i]), p) for a, b, p in s]) for i, s in enumerate(symbols)]
        table = np.full((len(codes), m.longest + 1), -1, np.int32)
        table[start, length] = piece
        short = lens <= LONG
        ends = self._merge_rounds(first[short], lens[short], table, len(codes))
        out: list[bytes] = [b""] * len(parts)
        begin = np.flatnonzero(ends >= 0)
        stop = ends[begin]
        ids = table[begin, np.minimum(stop - begin, m.longest)]
        ids[stop - begin > m.longest] = -1
        at = np.searchsorted(begin, first)
        to = np.searchsorted(begin, first + lens)
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        raw = ids.astype("<i4").tobytes()
        for i in range(len(parts)):
            if not short[i]:
                out[i] = self._ids(parts[i], self._merge_heap(int(first[i]), int(lens[i]), table))
            elif bad[to[i]] == bad[at[i]]:
                out[i] = raw[4 * at[i] : 4 * to[i]]
            else:
                f = int(first[i])
                out[i] = self._ids(parts[i], [(int(b) - f, int(e) - f, int(p)) for b, e, p in zip(begin[at[i] : to[i]], stop[at[i] : to[i]], ids[at[i] : to[i]])])
        return out

    def _merge_rounds(self, first: np.ndarray, lens: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
        """For each position where a final symbol begins, its end; else -1. One merge for each open stretch in a round."""
        end = np.full(n, -1, np.int64)
        pos = np.repeat(first, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        end[pos] = pos + 1
        of = np.repeat(np.arange(len(first)), lens)
        longest, rank = self.m.longest, np.append(self.m.rank, _NONE)
        while len(pos) > 1:
            pair = np.flatnonzero(of[1:] == of[:-1])
            a, stop = pos[pair], end[pos[pair + 1]]
            size = stop - a
            r = np.where(size <= longest, rank[table[a, np.minimum(size, longest)]], _NONE)
            ok = np.flatnonzero(r < _NONE)
            if not len(ok):
                break
            # The least rank of each stretch, and of equal ones the leftmost.
            o = of[pair[ok]]
            least = np.minimum.reduceat((r[ok].astype(np.int64) << 32) | np.arange(len(ok)), np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])))
            best = ok[least & 0xFFFFFFFF]
            left, right = pair[best], pair[best] + 1
            end[pos[left]] = end[pos[right]]
            end[pos[right]] = -1
            go = np.zeros(int(of.max()) + 1, bool)
            go[of[left]] = True
            keep = go[of]
            keep[right] = False
            pos, of = pos[keep], of[keep]
        return end

    def _merge_heap(self, f: int, n: int, table: np.ndarray) -> list[tuple[int, int, int]]:
        longest, rank = self.m.longest, self.m.rank
        end, prev = {i: i + 1 for i in range(f, f + n)}, {i: i - 1 for i in range(f, f + n)}
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end.get(a)
            if b is not None and b in end and end[b] - a <= longest and (p := table[a, end[b] - a]) >= 0:
                heapq.heappush(heap, (int(rank[p]), a, b, end[b]))

        for i in range(f, f + n - 1):
            offer(i)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end.get(a) != b or end.get(b) != c:
                continue
            end[a] = c
            del end[b]
            if c in end:
                prev[c] = a
            offer(a)
            if prev[a] in end:
                offer(prev[a])
        return [(a - f, end[a] - f, int(table[a, end[a] - a]) if end[a] - a <= longest else -1) for a in sorted(end)]

    def _best_sum(self, f: int, n: int, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> list[tuple[int, int, int]]:
        scores = self.m.scores
        worst = min(scores) - 10.0
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        lo, hi = np.searchsorted(start, [f, f + n])
        e = lo
        for i in range(n):
            one = False
            while e < hi and start[e] == f + i:
                k, p = int(length[e]), int(piece[e])
                one |= k == 1
                if best[i] + scores[p] > best[i + k]:
                    best[i + k], back[i + k] = best[i] + scores[p], (i, p)
                e += 1
            if not one and best[i] + worst > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + worst, (i, -1)
        out, i = [], n
        while i:
            j, p = back[i]
            out.append((f + j, f + i, p))
            i = j
        return out[::-1]

    def _ids(self, part: str, symbols: list[tuple[int, int, int]]) -> bytes:
        m, out = self.m, []
        for a, b, p in symbols:
            if p >= 0:
                out.append(p)
            elif m.fallback:
                out += [m.byte[x] for x in part[a:b].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != m.unknown:
                out.append(m.unknown)
        return np.array(out, "<i4").tobytes()


def decoded(m: Model, ids: list[int]) -> bytes:
    """The bytes of ids: without the first space mark, or with squeezed spaces without any before other text."""
    if m.squeeze:
        start = 0
        while start < len(ids) and m.text[ids[start]] == b" ":
            start += 1
        ids = ids[start:]
        out = b"".join([m.text[i] for i in ids])
        return out[1:] if out[:1] == b" " else out
    out = b"".join([m.text[i] for i in ids])
    return out[1:] if m.prefix and out[:1] == b" " else out


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _encode(path: str, back: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in it:
            for lo, texts in pieces(b.column("sp_text"), BATCH_BYTES):
                got = e.encode([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                out = {"sp_id": b.column("sp_id").slice(lo, len(texts)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<i4")))}
                if back:
                    out["decoded_sha256"] = pa.array([hashlib.sha256(decoded(e.m, np.frombuffer(g, "<i4").tolist())).hexdigest() for g in got], pa.string())
                yield pa.record_batch(out)

    return run


def _decode(path: str, ids: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path)
        for b in it:
            col = b.column(ids)
            offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            null = col.is_null().to_pylist()
            rows = [None if null[i] else decoded(m, flat[offsets[i] : offsets[i + 1]].tolist()).decode("utf-8", "replace") for i in range(len(col))]
            yield pa.record_batch([*(b.column(i) for i in range(b.num_columns)), pa.array(rows, pa.string())], names=[*b.schema.names, "decoded"])

    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """id_col and ids (array<int>), as the model's library gives them without begin or end, for each row of df.

    back: also decoded_sha256, the digest of the bytes that the ids decode to. A null text is encoded as an empty
    one, to an empty array. Equal rows are encoded alike and as often as they occur; an empty table gives no rows;
    other columns of df play no part.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("sp_id"), F.col(text).alias("sp_text"))
    return rows.mapInArrow(_encode(model, back), f"sp_id {kind}, ids array<int>" + ", decoded_sha256 string" * back).withColumnRenamed("sp_id", id_col)


def decode(df: DataFrame, model: str) -> DataFrame:
    """df (with ids, a bare array<int> column) and decoded: the text of each row's ids; null for null ids.

    A column of df that is named decoded, in whatever case, gives way. An empty table gives no rows.
    """
    mine, names = positional(df)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(mine.columns, df.schema.fields))
    out = mine.mapInArrow(_decode(model, names["ids"]), f"{kinds}, decoded string")
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() != "decoded"], "decoded")
