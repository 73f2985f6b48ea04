"""The registered queries: rows of their SQL, or of a brute-force version."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fenmark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(Q.queries()[name](spark, sf), *columns) == sorted(want.fetchall(), key=repr)


def test_op1(spark, sf, docs):
    out = Q.op1_language_id(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(truth)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, truth[i].text or "")))
    held = [i for i in got if got[i].held_out and truth[i].lang]
    assert np.mean([got[i].lang_pred == truth[i].lang for i in held]) > 0.95


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_op3(spark, sf, docs):
    out = {r.doc_id: r for r in Q.op3_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(out) == set(texts)
    right = 0
    for i, t in texts.items():
        r, want = out[i], brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [i for i in labels if i in out and not out[i].base_failed]
    right = sum(out[i].kept == (labels[i] == 1) for i in judged)
    assert right >= 0.9 * len(judged)
    # An empty list would reject none of these.
    bad = [i for i in judged if labels[i] == 0]
    assert bad and sum(not out[i].kept for i in bad) >= 0.5 * len(bad)


def test_op4(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    for r, d in zip(*(sorted(x, key=lambda r: r.doc_id) for x in (Q.op4_token_counts(spark, sf).collect(), docs.collect()))):
        n = len(t.encode(d.text or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d.doc_id, len((d.text or "").encode()), n, n > 1024)


def test_op5(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in t], float), np.array([r.vec_id for r in t])
    got = {}
    for r in Q.op5_graph_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        assert all(abs(f[2] - s[ids == f[1]][0]) < 1e-9 for f in found)
        hits += len({int(ids[i]) for i in order} & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op6(spark, sf, docs):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in Q.op6_sentencepiece(spark, sf).collect():
        assert list(r.ids) == s.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest()


def test_op7(spark, sf, docs):
    got = Q.op7_source_mixing(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, Q.op7_source_mixing(spark, sf).collect()))
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id for r in got} == set(sizes) and len(got) == len(sizes)
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    own = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(own.values()), {s for s in names if own[s]}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * own[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left, open_ = left - sum(2.0 * own[s] for s in full), open_ - full
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == sizes[r.doc_id] and r.source_size == own[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])


def test_op9(spark, sf, docs):
    """Exact copies of normal forms, by brute force; links of different lines only ever remove more."""
    lines = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for i, line in enumerate((r.text or "").split("\n")):
            if w := tuple(WORD.findall(line.lower())):
                lines.setdefault(w, []).append((r.doc_id, i))
    must = {at for places in lines.values() for at in places[1:]}
    got = {(r.doc_id, i) for r in Q.op9_line_dedup(spark, sf).collect() for i in r.removed}
    assert must <= got
    n = {r.doc_id: r.n_lines for r in Q.op9_line_dedup(spark, sf).collect()}
    assert sum(n.values()) == sum(map(len, lines.values())) and set(n) == {r.doc_id for r in docs.collect()}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P

    assert [k for k, _ in P.STAGES] == ["quality rules", "line dedup", "near-dedup", "source mixing", "sentencepiece"]
    now, seen = docs, []
    for k, f in P.STAGES[:-1]:
        now = f(spark, now, sf).cache()
        assert now.columns == docs.columns
        seen.append(now)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in seen[0].collect()}
    stats = {i: brute_stats(t) for i, t in texts.items()}
    assert all(not (stats[i][0] < 20 or 100 * stats[i][4] > 30 * stats[i][0]) for i in kept)
    lined = {r.doc_id: r.text for r in seen[1].collect()}
    assert set(lined) == kept
    forms = [tuple(WORD.findall(x.lower())) for t in lined.values() for x in t.split("\n") if WORD.search(x)]
    assert len(forms) == len(set(forms))

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in lined.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert {r.doc_id for r in seen[2].collect()} == {i for i in root if root[i] == i}
    copies = {r.doc_id: r["count"] for r in seen[3].groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in seen[2].collect()}
    total = sum(len(WORD.findall(r.text or "")) for r in seen[2].collect())
    mixed = sum(len(WORD.findall(r.text or "")) for r in seen[3].collect())
    assert abs(mixed - 1.5 * total) < 0.1 * total
    assert P.STAGES[-1][1](spark, seen[3], sf).count() == seen[3].count()
