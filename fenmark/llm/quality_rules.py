"""Quality rules: an ordered decision list over text statistics, learned by sequential covering.

Statistics of every whole text are taken once. From labelled rows, rules that reject are grown one threshold at a
time by information gain, pruned on rows kept aside, and kept while they are precise; the list becomes an ordered
conditional expression over the statistics, which Spark evaluates for all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

SYMBOLS = "#*$%&|<>"
#: What rules may test; the first five of each text are whole numbers.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "letter_share", "mark_share", "top_word_share", "words_a_line"]
MAX_TRAIN = 20_000  # labelled rows that the list is learned from, chosen by a hash of their id (as an expected value)


def repeated_words(ids: np.ndarray, k: int = 8) -> int:
    """Words in windows of k that occur twice or more; ids: a number for each word, equal for equal words."""
    if len(ids) <= k:
        return 0
    code, size, have = ids.astype(np.int64), 1, {1: ids.astype(np.int64)}
    while size < k:
        step = min(size, k - size)  # a window of size + step is a window of size and the one step later
        a = code[: len(ids) - size - step + 1]
        b = code[step : step + len(a)]
        _, code = np.unique(a * (int(code.max()) + 1) + b, return_inverse=True)
        size += step
        have[size] = code
        if size < k and len(np.unique(code)) == len(code):
            return 0  # nothing repeats at this length, nor at any greater
    counts = np.bincount(code)
    again = counts[code] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    cover[at] += 1
    np.subtract.at(cover, at + k, 1)
    return int((np.cumsum(cover)[: len(ids)] > 0).sum())


_kind: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """For each code point: 2 for an upper-case letter, 1 for another letter, else 0."""
    global _kind
    if _kind is None:
        _kind = np.fromiter((chr(c).isalpha() + (chr(c).isalpha() and chr(c).isupper()) for c in range(0x110000)), np.uint8, 0x110000)
    return _kind


def statistics(text: str | None) -> tuple:
    """COUNTS and RATIOS of a text; of null as of an empty one. A ratio without a base is 0."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(ids)
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3) if chars else (0, 0, 0)
    letters, up = int(kinds[1] + kinds[2]), int(kinds[2])
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, "!?|"))
    top = int(np.bincount(ids).max()) if n else 0
    d = lambda a, b: a / b if b else 0.0
    return (n, chars, symbols, dup, repeat, d(chars, n), d(symbols, chars), d(dup, lines), d(repeat, n), d(len(number), n), d(up, letters), d(digits, chars), d(letters, chars), d(marks, chars), d(top, n), d(n, lines))


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo, texts in pieces(b.column("q_text"), 4 << 20):
            rows = list(zip(*map(statistics, texts)))
            yield pa.record_batch(
                {"q_id": b.column("q_id").slice(lo, len(texts))}
                | {k: pa.array(v, pa.int64()) for k, v in zip(COUNTS, rows)}
                | {k: pa.array(v, pa.float64()) for k, v in zip(RATIOS, rows[len(COUNTS) :])}
            )


def measure(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col (a whole number) and the statistics of each row's text."""
    kinds = ", ".join([f"{k} long" for k in COUNTS] + [f"{k} double" for k in RATIOS])
    return df.select(F.col(id_col).cast("long").alias("q_id"), F.col(text).alias("q_text")).mapInArrow(_measure, f"q_id long, {kinds}").withColumnRenamed("q_id", id_col)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    value: float

    def hit(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.value if self.above else x[self.name] <= self.value

    def column(self) -> Column:
        return F.col(self.name) > self.value if self.above else F.col(self.name) <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


def _thresholds(v: np.ndarray, most: int = 64) -> np.ndarray:
    u = np.unique(v)
    if len(u) > most:
        u = np.unique(np.quantile(u, np.linspace(0, 1, most)))
    return (u[1:] + u[:-1]) / 2


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for t in rule:
        ok &= t.hit(x)
    return ok


def _grow(x: dict[str, np.ndarray], y: np.ndarray, deepest: int) -> list[Test]:
    rule: list[Test] = []
    ok = np.ones(len(y), bool)
    while len(rule) < deepest and ok.any() and not y[ok].all():
        p0, n0 = int(y[ok].sum()), int(ok.sum())
        before, best = math.log2(p0 / n0) if p0 else -60.0, (0.0, None)
        for name in x:
            v, yy = x[name][ok], y[ok]
            cuts = _thresholds(v)
            if not len(cuts):
                continue
            order = np.argsort(v, kind="stable")
            pos = np.concatenate([[0], np.cumsum(yy[order])])
            k = np.searchsorted(v[order], cuts, side="right")
            for above in (False, True):
                p, n = (pos[-1] - pos[k], n0 - k) if above else (pos[k], k)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - before), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), Test(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        ok &= best[1].hit(x)
    return rule


def _prune(rule: list[Test], x: dict[str, np.ndarray], y: np.ndarray) -> list[Test]:
    def worth(r: list[Test]) -> float:
        c = _covered(r, x, len(y))
        return (2 * y[c].sum() - c.sum()) / max(1, c.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(x: dict[str, np.ndarray], reject: np.ndarray, precision: float = 0.95, cover: int = 5, most: int = 24, deepest: int = 4, seed: int = 5) -> list[list[Test]]:
    """Rules that reject, in order. Without rejected or without accepted rows there are none, so everything is kept."""
    y = reject.astype(bool)
    left = np.ones(len(y), bool)
    turn = np.random.default_rng(seed).permutation(len(y)) % 3
    rules: list[list[Test]] = []
    while len(rules) < most and y[left].any() and not y[left].all():
        g, p = left & (turn > 0), left & (turn == 0)
        part = lambda m: {k: v[m] for k, v in x.items()}
        rule = _grow(part(g), y[g], deepest)
        if not rule:
            break
        rule = _prune(rule, part(p), y[p]) if y[p].any() else rule
        hit = _covered(rule, x, len(y)) & left
        held = hit & (turn == 0)
        good, n = int(y[hit].sum()), int(hit.sum())
        if n < cover or good / n < precision or (held.any() and y[held].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional: the number of the first rule that fits, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        cond = rules[i][0].column()
        for t in rules[i][1:]:
            cond = cond & t.column()
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 20) | (100 * F.col(n_repeat) > 30 * F.col(n_words))


def _sampled(labels: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of the labels, chosen by a hash of their id; all if there are fewer."""
    share = min(1.0, most / max(1, labels.count()))
    return labels if share == 1 else labels.filter(F.pmod(F.xxhash64(F.lit(13), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN) -> list[list[Test]]:
    """Learns from rows with a label (0: reject), about max_train of them at most; nulls and unknown ids play no part."""
    labels = labels.select(F.col(id_col).cast("long").alias("q_id"), F.col(label).alias("q_label")).filter("q_id is not null and q_label is not null").groupBy("q_id").agg(F.min("q_label").alias("q_label"))
    names = COUNTS[:2] + RATIOS
    labels = _sampled(labels, "q_id", max_train)
    rows = stats.join(labels, F.col(id_col) == F.col("q_id")).filter(~base_failed()).select("q_id", "q_label", *names).toPandas().sort_values(["q_id", *names], kind="stable")
    if rows.empty:
        return []
    return learn({k: rows[k].to_numpy(np.float64) for k in names}, rows["q_label"].to_numpy() == 0)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rules: list[list[Test]] | None = None) -> DataFrame:
    """id_col, the counts, base_failed, rule (the first that fits; null if none) and kept, for each row of df.

    A null text has no words, so it fails the base rules. Rows with equal ids or texts each get their row; without
    labels only the base rules reject; an empty table gives no rows. Other columns of df play no part.
    """
    stats = written(measure(df, id_col, text), "quality-stats")
    rules = fit(stats, labels, id_col) if rules is None else rules
    return stats.select(id_col, *COUNTS, base_failed().alias("base_failed"), expression(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def _measure_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the statistics of their column q_text put behind their other columns."""
    for b in it:
        kept = [n for n in b.schema.names if n != "q_text"]
        for lo, texts in pieces(b.column("q_text"), 4 << 20):
            rows = list(zip(*map(statistics, texts)))
            own = b.slice(lo, len(texts))
            yield pa.record_batch([own.column(n) for n in kept] + [pa.array(v, pa.int64() if i < len(COUNTS) else pa.float64()) for i, v in enumerate(rows)], names=kept + COUNTS + RATIOS)


def fit_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> list[list[Test]]:
    """As fit, measuring only the documents of max_train labels, chosen by a hash of their id."""
    some = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label)).filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias(label))
    some = _sampled(some, id_col, max_train)
    own = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("text"))
    # The sample has about max_train rows of two numbers.
    return fit(measure(own.join(F.broadcast(some.select(id_col)), id_col), id_col, "text"), some, id_col, label, max_train)


def kept_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows and columns without the rows that fail the base rules or that a rule rejects, in one pass.

    Rows are judged by their own text alone: equal rows share a verdict, a null text fails, a null id doesn't matter.
    """
    rules = fit_documents(df, labels, id_col, text)
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], F.col(text).alias("q_text"))
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields)] + [f"{k} long" for k in COUNTS] + [f"{k} double" for k in RATIOS]
    judged = rows.mapInArrow(_measure_all, ", ".join(kinds)).filter(~base_failed() & expression(rules).isNull())
    return judged.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)])
