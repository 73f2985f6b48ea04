"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of whole lower-cased texts, every run of other characters than letters read as one space, are hashed to DIMS features. Document
frequencies cover all training rows. Weights follow the regularised leader with L1 and L2 penalties on a bounded,
stratified sample; a temperature fitted on rows left out of that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

DIMS = 1 << 15
GRAMS = (1, 2, 3)
PER_LANG, MAX_TRAIN = 1_500, 8_000  # rows of a language, and of all, that weights are fitted on (as expected values of a hash sample)
MAX_LANGS = 1_000
L1 = 0.3  # of the elastic net: features whose summed gradients stay below it have no weight
PIECE = 1 << 19  # n-grams hashed at once
UNKNOWN = "und"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def _add(codes: np.ndarray, out: np.ndarray) -> None:
    """Counts the n-grams, in pieces of bounded memory: each by the piece in which it begins."""
    for i in range(0, len(codes), PIECE):
        for n in GRAMS:
            c = codes[i : i + PIECE + n - 1].astype(np.uint64)
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h + c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                out += np.bincount((mix(h) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their counts; none if it is null or has no letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[codes]
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = ok.copy()  # a letter, or the first of a run of other characters
    first[0] = True
    first[1:] |= ok[:-1]
    out = np.zeros(DIMS, np.int64)
    _add(np.where(ok, codes, np.uint32(32))[first], out)
    at = np.flatnonzero(out)
    return at, out[at]


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(DIMS, np.int64), 0
    for b in it:
        for t in b.column("li_text").to_pylist():
            at, _ = features(t)
            df[at] += 1
            rows += 1
    at = np.flatnonzero(df)
    yield pa.record_batch({"f": pa.array(np.append(at, DIMS), pa.int64()), "n": pa.array(np.append(df[at], rows), pa.int64())})


def _sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        got = [features(t) for t in b.column("li_text").to_pylist()]
        yield pa.record_batch(
            {
                "li_lang": b.column("li_lang"),
                "at": pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
                "n": pa.array([n.astype(np.int32) for _, n in got], pa.list_(pa.int32())),
            }
        )


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS + 1 rows (the last is the bias), a column for each language
    temperature: float = 1.0

    def __getstate__(self) -> dict:
        """What tasks are sent: only the weights that aren't zero."""
        at = np.flatnonzero(self.weights)
        return self.__dict__ | {"weights": (self.weights.shape, at.astype(np.int32), self.weights.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["weights"]
        weights = np.zeros(shape, values.dtype)
        weights.ravel()[at] = values
        self.__dict__.update(state | {"weights": weights})

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        return v / max(np.sqrt(v @ v), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.weights[DIMS]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = features(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, n) / self.temperature)
        i = int(np.argmax(p))  # of equal ones the first language by code point
        return self.langs[i], float(min(1.0, p[i]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = L1, l2: float = 0.02, epochs: int = 3, seed: int = 3) -> np.ndarray:
    """FTRL-proximal weights for rows of (features, values, class)."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.append(at, DIMS), np.append(v, 1.0)
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax(v @ w)
            p[y] -= 1.0
            g = np.outer(v, p)
            g2 = nn + g * g
            z[at] = zz + g - (np.sqrt(g2) - np.sqrt(nn)) / alpha * w
            n[at] = g2
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with id, text and language; the sample's rows are chosen by a hash of their id.

    More than MAX_LANGS languages are an error: the model has a column for each. Nulls in any of the three play no part.
    """
    rows = train.select(F.col(id_col).cast("string").alias("li_id"), F.col(text).alias("li_text"), F.col(lang).alias("li_lang")).filter("li_text is not null and li_lang is not null and li_id is not null")
    counts = {r["li_lang"]: r["count"] for r in rows.groupBy("li_lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS + 1, 0)))
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("li_text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows at most
        df[r["f"]] = r["n"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    each = min(PER_LANG, max(20, MAX_TRAIN // len(langs)))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, int(min(1.0, each / counts[k]) * (1 << 30)))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(11), "li_id"), F.lit(1 << 30)) < share[F.col("li_lang")])
    got = sample.select("li_text", "li_lang").mapInArrow(_sparse, "li_lang string, at array<int>, n array<int>").toArrow()
    model = Model(langs, idf, np.zeros((DIMS + 1, len(langs))))
    number = {k: i for i, k in enumerate(langs)}
    ready = []
    for b in got.to_batches():
        offsets = b.column("at").offsets.to_numpy()
        at, n = b.column("at").values.to_numpy(), b.column("n").values.to_numpy()
        for i, k in enumerate(b.column("li_lang").to_pylist()):
            s = slice(offsets[i], offsets[i + 1])
            if s.stop > s.start:
                ready.append((at[s].astype(np.int64), model.vector(at[s], n[s]), number[k]))
    # An order that doesn't depend on the order of arrival, so that reruns learn the same.
    ready.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum()), r[0].tobytes()))
    aside = np.random.default_rng(1).permutation(len(ready)) % 5 == 0
    if not (~aside).any():
        aside[:] = False
    model.weights = follow_the_leader([r for r, a in zip(ready, aside) if not a], len(langs))
    left = [r for r, a in zip(ready, aside) if a]
    model.temperature = temperature(np.array([v @ model.weights[at] + model.weights[DIMS] for at, v, _ in left]).reshape(len(left), len(langs)), np.array([y for *_, y in left], dtype=np.int64))
    model.weights = model.weights.astype(np.float32)
    return model


def _predict(model: Model):
    def run(it):
        for b in it:
            got = [model.predict(t) for t in b.column("li_text").to_pylist()]
            yield pa.record_batch({"li_id": b.column("li_id"), "li_out": b.column("li_out"), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    return run


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col (a whole number), held_out, lang_pred and score of each row of df.

    A text that is null or has no letter is `und` with score 0; so is every text where nothing was learned. A null
    id is not held out. Equal rows are answered alike and as often as they occur; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("li_id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("li_out"), F.col(text).alias("li_text"))
    return rows.mapInArrow(_predict(model), "li_id long, li_out boolean, lang_pred string, score double").withColumnsRenamed({"li_id": id_col, "li_out": "held_out"})
