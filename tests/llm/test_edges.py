"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenmark.llm import language_id, line_dedup, minhash, mixing, quality_rules, sentencepiece_codec, substring_dedup, token_counts, url_filters, vamana
from fenmark.llm import queries as Q
from fenmark.llm.common import components, fresh_path

N = 15  # rows of `odd`


def test_language_id(odd, none, spark):
    model = language_id.fit(odd.filter("lang is not null"))
    out = language_id.identify(odd, model).collect()
    assert len(out) == N
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {3, 4, 5, 10}
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_language_id_temperature():
    logits = np.array([[4.0, 0.0]] * 10)
    y = np.array([0] * 7 + [1] * 3)
    t = language_id.temperature(logits, y)
    assert language_id.softmax(logits[0] / t)[0] == pytest.approx(0.7, abs=1e-3)


@pytest.mark.parametrize("piece", [1, 2, 7, 100])
def test_long_texts_have_the_features_of_their_pieces(monkeypatch, piece):
    """Wherever a long text is cut, also within runs of other characters, nothing is counted twice or lost."""
    text = "Öffentliche Gebäude und Straßen, 12 -- " * 40 + "\n\n 漢字 "
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert all(np.array_equal(a, b) for a, b in zip(whole, language_id.features(text)))


def brute_features(text):
    """Characters one by one: letters lower-cased, any run of others as one space, n-grams counted by their hash."""
    run = [" "]
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or run[-1] != " ":
            run.append(c)
    out = {}
    for n in language_id.GRAMS:
        for i in range(len(run) - n + 1):
            h = n
            for c in run[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            f = int(language_id.mix(np.array([h], np.uint64))[0] % np.uint64(language_id.DIMS))
            out[f] = out.get(f, 0) + 1
    return out


def test_language_id_by_brute_force(spark):
    """The leader's weights, the sparse model that tasks get, and the answers, recomputed value by value."""
    import math
    import pickle

    rng = np.random.default_rng(4)
    words = {"xx": ["alpha", "beta", "gamma", "the"], "yy": ["óla", "casa", "mar", "the"], "zz": ["ding", "haus", "über", "the"]}
    texts = [(k, " ".join(rng.choice(w, 12))) for _ in range(8) for k, w in words.items()]
    langs = sorted(words)
    feats = [brute_features(t) for _, t in texts]
    assert all(dict(zip(*map(np.ndarray.tolist, language_id.features(t)))) == f for (_, t), f in zip(texts, feats))
    df = {}
    for f in feats:
        for k in f:
            df[k] = df.get(k, 0) + 1
    idf = np.array([math.log((1 + len(texts)) / (1 + df.get(k, 0))) + 1 for k in range(language_id.DIMS)])
    m = language_id.Model(langs, idf, np.zeros((language_id.DIMS + 1, 3)))
    rows = []
    for (k, _), f in zip(texts, feats):
        at = np.array(sorted(f))
        rows.append((at, m.vector(at, np.array([f[i] for i in at.tolist()])), langs.index(k)))
    alpha, beta, l1, l2 = 2.0, 1.0, 0.3, 0.02
    z, n = {}, {}

    def weight(i, c):
        zz, nn = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((beta + math.sqrt(nn)) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            x = [*zip(at.tolist(), v.tolist()), (language_id.DIMS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            s = [sum(a * w[i, c] for i, a in x) for c in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            for i, a in x:
                for c in range(3):
                    g = a * (e[c] / sum(e) - (c == y))
                    was = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[i, c]
                    n[i, c] = was + g * g
    got = language_id.follow_the_leader(rows, 3, alpha, beta, l1, l2)
    assert all(got[i, c] == pytest.approx(weight(i, c), abs=1e-9) for i, c in z) and np.count_nonzero(got) < 0.9 * len(z)
    m.weights = got.astype(np.float32)
    sent = pickle.loads(pickle.dumps(m))
    assert np.array_equal(sent.weights, m.weights) and len(pickle.dumps(m)) < idf.nbytes + 12 * np.count_nonzero(got) + 10_000
    for k, t in [*texts, ("zz", "haus ding the")]:
        f = brute_features(t)
        v = {i: math.log1p(c) * idf[i] for i, c in f.items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        s = [sum(a / norm * m.weights[i, c] for i, a in v.items()) + m.weights[language_id.DIMS, c] for c in range(3)]
        e = [math.exp(a - max(s)) for a in s]
        assert sent.predict(t) == (langs[int(np.argmax(s))], pytest.approx(max(e) / sum(e), abs=1e-6)) and sent.predict(t)[0] == k


def test_quality_rules(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (11, 0), (None, 0), (12, None), (404, 0)], "doc_id long, quality int")
    out = quality_rules.judge(odd, labels).collect()
    assert len(out) == N
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (3, 4, 5, 11))
    assert quality_rules.judge(odd, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    kept = quality_rules.kept_documents(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_decision_list_is_learned_and_ordered(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(2000), "b": rng.random(2000), "noise": rng.random(2000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.5))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= quality_rules._covered(r, x, 2000)
    assert (hit == bad).mean() > 0.98
    df = spark.createDataFrame([(0.9, 0.5), (0.3, 0.1), (0.3, 0.9)], "a double, b double").withColumn("noise", F.lit(0.5))
    assert [r[0] is not None for r in df.select(quality_rules.expression(rules)).collect()] == [True, True, False]
    assert quality_rules.learn(x, np.zeros(2000, bool)) == []


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 5, 8, 9, 30, 200):
        for kinds in (1, 2, 5):
            ids = rng.integers(0, kinds, n)
            at = {}
            for i in range(n - 7):
                at.setdefault(tuple(ids[i : i + 8]), []).append(i)
            want = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
            assert quality_rules.repeated_words(ids) == len(want)


def test_substring_dedup(odd, none):
    out = {(r.doc_id, r.kept): r for r in substring_dedup.remove_repeats(odd).collect()}
    by = {r.doc_id: r for r in out.values()}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_words == 3000 and by[2].spans[0].asDict() == {"first": 0, "last": 2999}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].kept == ""
    assert by[11].n_removed == 0  # repeats inside one text don't count
    assert substring_dedup.remove_repeats(odd).count() == N
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_over_blocks_and_windows(spark, monkeypatch):
    """Many small blocks and buckets, short windows, odd spaces, by brute force."""
    import random

    rng = random.Random(1)
    texts = [rng.choice([" ", "\t", "\n "]).join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=6).collect()}
    first = {}
    words = [t.split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - 5):
            first.setdefault(tuple(w[i : i + 6]), d)
    for d, w in enumerate(words):
        gone = {i + j for i in range(len(w) - 5) if first[tuple(w[i : i + 6])] < d for j in range(6)}
        assert got[d] == (len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_colliding_hashes_are_told_apart():
    values, text = np.array([5, 3, 9, 4, 7]), ["a", "b", "a", "b", "c"]
    same = lambda i, j: np.array([text[a] == text[b] for a, b in zip(i, j)], bool)
    assert substring_dedup.smallest(np.array([1, 1, 1, 1, 2], np.uint64), values, same).tolist() == [5, 3, 5, 3, 7]


def test_token_counts_and_cache(odd, none, spark):
    cache = fresh_path(spark, "test-cache")
    path = Q.tokenizer_path("byte_bpe_50k.json")
    out = token_counts.count_tokens(odd, path, cache)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = sorted((r.text or "" for r in odd.select("text").collect()))
    assert sorted(r.n_tokens for r in out.collect()) == sorted(len(t.encode(x, add_special_tokens=False).ids) for x in texts)
    before = spark.read.parquet(cache).count()
    assert before == len(set(texts))
    assert token_counts.count_tokens(odd.union(odd), path, cache).count() == 2 * N
    assert spark.read.parquet(cache).count() == before  # all were known
    assert token_counts.count_tokens(none, path, fresh_path(spark, "test-cache")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n b", "a \n b", "x <|endoftext|> y", "don't  stop", "tab\t end ", "　wide　space a", "1 2  3", "\x1c a\x85b c"])
def test_stretches_add_up(text):
    c = token_counts.Counter(Q.tokenizer_path("byte_bpe_50k.json"))
    assert c.counts([text, text]) == c.many([text, text])


def test_sentencepiece(odd, none, spark):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(list(r.ids) for r in sentencepiece_codec.encode(odd, path).collect())
    assert got == sorted(s.encode(r.text or "") for r in odd.select("text").collect())
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, path), path)
    assert [c for c in back.columns if c.lower() == "decoded"] == ["decoded"]
    named = spark.createDataFrame([(1, [5], "old")], "doc_id long, ids array<int>, Decoded string")
    assert sentencepiece_codec.decode(named, path).columns == ["doc_id", "ids", "decoded"]
    assert sorted(r.decoded for r in back.collect()) == sorted((r.text or "").replace("▁", " ") for r in odd.select("text").collect())
    assert sentencepiece_codec.encode(none, path).count() == 0
    assert sentencepiece_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().decoded is None


def _field(number, kind, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else varint(value))


def test_other_piece_models(tmp_path):
    """The named model with squeezed spaces and with pieces of the user, by its library: files changed by hand, nothing trained."""
    import sentencepiece

    raw = open(Q.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    flags = {"squeeze": (1, ()), "user": (0, ("ing", "▁the", "▁house", "tion", "th")), "both": (1, ("and", "▁a", "er"))}
    rng = np.random.default_rng(5)
    words = ["the", "house", "thing", "nation", "bathing", "and", "hand", "", "", "a", "Ölande", "漢字", "\t", "zz"]
    texts = ["", " ", "   ", " the house", "the  house ", *[" ".join(rng.choice(words, 12)) for _ in range(200)]]
    for name, (squeeze, user) in flags.items():
        out = b""
        for n, v in sentencepiece_codec._fields(raw):
            if n == 1:
                got = dict(sentencepiece_codec._fields(v))
                if got[1].decode() in user:
                    v = v + _field(3, 0, sentencepiece_codec.USER)
            if n == 3 and squeeze:
                v = v + _field(4, 0, 1)
            out += _field(n, 2, v)
        path = str(tmp_path / f"{name}.model")
        open(path, "wb").write(out)
        s, e = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Encoder(path)
        got = [np.frombuffer(x, "<i4").tolist() for x in e.encode(texts)]
        assert got == [s.encode(t) for t in texts], name
        assert [sentencepiece_codec.decoded(e.m, g).decode() for g in got] == [s.decode(g) for g in got], name


def test_unigram_relaxation():
    """The best sum of scores, by brute force over all ways to cut a text."""
    m = object.__new__(sentencepiece_codec.Model)
    m.pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bb"]
    m.scores, m.kinds = [0.0, -2.0, -2.5, -3.0, -3.2, -4.1, -6.0], [2, 1, 1, 1, 1, 1, 1]
    m.known = {p: i for i, p in enumerate(m.pieces) if i}
    m.longest, m.unigram, m.fallback, m.unknown = 3, True, False, 0
    m.levels = m._trie()
    e = object.__new__(sentencepiece_codec.Encoder)
    e.m = m

    def best(t):
        return max(((m.scores[m.known[t[:k]]] + (best(t[k:]) if t[k:] else 0.0)) for k in (1, 2, 3) if t[:k] in m.known and len(t) >= k), default=-np.inf)

    texts = ["abab", "bbaab", "aba", "bbbb", "a"]
    for t, raw in zip(texts, e.relaxed(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert "".join(m.pieces[i] for i in ids) == t and sum(m.scores[i] for i in ids) == pytest.approx(best(t))


def test_mixing(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == N
    assert all(r.taken <= 2 * r["size"] for r in out) and {r.taken for r in out if r["size"] == 0} == {0}
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(odd.filter("doc_id in (3, 4, 5)")).collect()} == {0}
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns


def test_mixing_small_sources_among_large(spark):
    """Sources of under two blocks get their whole target, whatever points the schedule draws."""
    large = spark.range(3600).select(F.col("id").alias("doc_id"), F.format_string("large%d", F.col("id") % 3).alias("source"), F.expr("repeat('w ', 1000)").alias("text"))
    small = spark.range(17).select((F.col("id") + 10_000).alias("doc_id"), F.format_string("small%02d", "id").alias("source"), F.expr("repeat('w ', cast(150 + 50 * id as int))").alias("text"))
    out = mixing.mix(large.union(small), block_tokens=1024).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    few = [r for r in out if r.source_size < 1024]
    assert len(few) == 17 and all(r.target == 2 * r.source_size and r.taken == r.target for r in few)
    assert mixing.mixed(small.union(large), block_tokens=1024).filter("source like 'small%'").count() == 34


def test_mixing_follows_the_schedule(spark):
    """Every row's words and first slot, recomputed from the points; a schedule in another order gives other slots."""
    rng = np.random.default_rng(12)
    rows = [(i, f"s{rng.integers(5)}", " ".join("w" for _ in range(int(rng.integers(0, 120))))) for i in range(400)]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_tokens=50).collect()}
    names = sorted({s for _, s, _ in rows})
    size = {i: len(t.split()) for i, _, t in rows}
    source = {i: names.index(s) for i, s, _ in rows}
    total = [sum(size[i] for i in size if source[i] == k) for k in range(len(names))]
    targets = mixing.water_fill(total, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))], 1.5 * sum(total), 2.0)
    need = [-(-int(t) // 50) for t in targets]
    slots = [[] for _ in names]
    edges = np.cumsum(targets)
    drawn = int(np.ceil(1.02 * sum(targets) / 50)) + 64
    for k in range(drawn):
        at = int(np.searchsorted(edges, np.modf((k + 0.5) * mixing.GOLDEN)[0] * edges[-1], side="right"))
        slots[min(at, len(names) - 1)].append(k)
    # The order of a source's stream is that of the rows' hashes.
    keys = {r.doc_id: (r.bucket, r.m_key) for r in spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("m_key", F.xxhash64(F.lit(17), "doc_id", "text")).withColumn("bucket", F.shiftrightunsigned("m_key", 64 - int(np.ceil(np.log2(400) / 2)))).collect()}
    for k in range(len(names)):
        place = 0
        stop = int(targets[k])
        used, first = {}, {}
        order = sorted((i for i in size if source[i] == k and size[i]), key=lambda i: keys[i])
        for lap in range(2):
            for i in order:
                for w in range(place, min(place + size[i], stop)):
                    b = w // 50
                    slot = slots[k][b] if b < len(slots[k]) else drawn + b * len(names) + k
                    used[i] = used.get(i, 0) + 1
                    first[i] = min(first.get(i, slot), slot)
                place += size[i]
        assert len(slots[k]) >= 1 and need[k] > 0
        for i in (i for i in size if source[i] == k):
            assert (out[i].taken, out[i].first_slot) == (used.get(i, 0), first.get(i))


def test_water_filling():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.water_fill([0, 10], [3, 1], 15, 2) == [0, 15]
    assert mixing.water_fill([], [], 0, 2) == []


def test_url_filters(spark):
    rules = url_filters.rules_table(spark, [*Q.URL_RULES, ("block", "org", "/"), ("allow", None, "/"), ("block", "", "/")])
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://a.b.example.org/en/12?q", "http://example.org", "http://notexample.org/es/", "https://x.com/de/#y", "x://y://example.org/es/", "http://ORG/"]
    df = spark.createDataFrame([(i, u, "old", "old", "old") for i, u in enumerate(urls)], "page_id long, url string, rule string, Host string, k_host string")
    assert url_filters.judge_urls(df, rules).columns == ["page_id", "url", "k_host", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[5] == ("a.b.example.org", "/en/12", "example.org/en/1", "block")
    assert got[6] == ("example.org", "", None, "allow")
    assert got[7] == ("notexample.org", "/es/", "org/", "block")  # of equal rules the block
    assert got[8] == ("x.com", "/de/", "com/de/", "block")
    assert got[9] == ("y:", "//example.org/es/", None, "allow")
    assert url_filters.judge_urls(df, rules.limit(0)).filter("verdict <> 'allow'").count() == 0
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


def test_line_dedup(odd, none):
    out = line_dedup.line_report(odd)
    got = sorted(((r.doc_id, r.n_lines, tuple(r.removed)) for r in out.collect()), key=repr)
    assert len(got) == N
    assert (6, 3, (1,)) in got and (7, 2, (0,)) in got and (None, 2, (1,)) in got and (2, 1, (0,)) in got and (3, 0, ()) in got
    assert got.count((8, 1, ())) == 2  # equal ids are one document
    clean = line_dedup.without_duplicate_lines(odd)
    assert clean.columns == odd.columns and clean.count() == N
    assert {r.text for r in clean.filter("doc_id = 2").collect()} == {""}
    assert line_dedup.line_report(none).count() == 0


def test_simhash_blocks_are_signs_of_weighted_votes(spark):
    """By brute force: each bit's votes, weighed by halves in the order of the shingles' hashes, without those that decided a block before."""
    rng = np.random.default_rng(2)
    lines = [[f"word{i}" for i in rng.integers(0, 50, n)] for n in (9, 10, 12, 40, 257, 1000)] + [["same"] * 30, ["a", "b", "c"] * 40]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, w array<string>").withColumn("n", F.size("w"))
    k, most = line_dedup.block_plan(90)
    got = {r.k: list(r.b) for r in df.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).select("k", line_dedup.simhash_blocks("h", 90).alias("b")).collect()}
    pair = lambda i: f"xxhash64(xxhash64(w[{i}]), xxhash64(w[{i} + 1]))"
    hashed = df.withColumn("s", F.expr(f"transform(sequence(0, n - {k}), i -> xxhash64({pair('i')}, {pair('i + 1')}))")).collect()
    for r in hashed:
        left, want = sorted(set(r.s)), []
        while left and len(want) < most:
            weights = [0.5**i for i in range(len(left))]
            bits = [sum(w if (h >> b) & 1 else -w for w, h in zip(weights, left)) > 0 for b in range(64)]
            value = sum(1 << b for b, on in enumerate(bits) if on)
            want.append(value - (1 << 64) if value >> 63 else value)
            left = left[1:]
        assert got[r.k] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(lines):
    """Each line's smallest linked line, by the edits of all pairs."""
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if root[a] != root[b] and distance(lines[a], lines[b]) <= 10 * max(len(lines[a]), len(lines[b])) // 100:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_large_buckets_of_lines_by_brute_force(spark):
    """Two crowds that share a passage, each around one line, and lines that only others link: every link counts, and no other."""
    rng = np.random.default_rng(6)
    shared = [f"token{i:03d}" for i in rng.integers(0, 400, 60)]
    bases = [shared + [f"token{i:03d}" for i in rng.integers(0, 400, 60)] for _ in range(3)]
    lines = []
    for k in range(75):
        w = list(bases[k % 3])
        for at in rng.integers(0, len(w), k % 9):
            w[at] = f"edit{k}x{at}"
        lines.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    report = {r.doc_id: r.n_removed for r in line_dedup.line_report(df).collect()}
    root = linked(lines)
    assert {i for i, n in report.items() if n == 0} == {i for i in range(75) if root[i] == i} and 1 < len(set(root)) < 40


def test_words_that_share_a_character(spark, monkeypatch):
    """With few characters for words most pairs are counted again, exactly: no link that the words don't have."""
    monkeypatch.setattr(line_dedup, "PLANES", 3)
    rng = np.random.default_rng(21)
    lines = []
    for k in range(20):
        w = [f"token{i}" for i in rng.integers(0, 3000, 40)]
        lines += [w, [*w[:10], *[f"other{k}{i}" for i in range(2 + 3 * (k % 2))], *w[12 + 3 * (k % 2) :]]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    root = linked(lines)
    assert {r.doc_id for r in line_dedup.line_report(df).collect() if not r.n_removed} == {i for i in range(40) if root[i] == i}
    assert len(set(root)) == 30


def _edited(rng, w, edits):
    w = list(w)
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"edit{rng.integers(1 << 40)}"
    return w


def test_recall_of_edited_lines_by_brute_force(spark):
    """Lines of 10 to 40 words and their copies with a tenth of the words replaced, or a word moved in or out; nothing but the edits decides."""
    rng = np.random.default_rng(11)
    first = [[f"token{i}" for i in rng.integers(0, 3000, 10 + k % 31)] for k in range(600)]
    second = []
    for k, w in enumerate(first):
        near = _edited(rng, w, (1, len(w) // 10, 1 + len(w) // 10)[k % 3])
        at = int(rng.integers(len(w)))
        second.append((near, w[:at] + w[at + 1 :], near)[k % 5 % 3])

    alike = {k for k, (a, b) in enumerate(zip(first, second)) if distance(a, b) <= 10 * max(len(a), len(b)) // 100}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(first + second)], "doc_id long, text string")
    gone = {r.doc_id - len(first) for r in line_dedup.line_report(df).collect() if r.n_removed}
    assert 300 < len(alike) < 600 and gone <= alike
    assert len(gone) >= 0.999 * len(alike)


def test_lines_of_short_words(spark):
    """Lines that differ in one word of under four characters, with and without longer words beside it, and lines of CJK words."""
    rng = np.random.default_rng(13)
    short = [f"{i:02x}" for i in range(256)]
    cjk = [chr(0x4E00 + i) for i in range(256)]
    pairs = []
    for k in range(40):
        words = [short, cjk, short + [f"token{i}" for i in range(256)]][k % 3]
        a = [words[i] for i in rng.integers(0, len(words), 10 + k % 20)]
        at = int(rng.integers(len(a)))
        pairs.append((a, [*a[:at], f"x{k % 10}", *a[at + 1 :]]))
    df = spark.createDataFrame([(2 * i + j, " ".join(w)) for i, p in enumerate(pairs) for j, w in enumerate(p)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.line_report(df).collect() if r.n_removed} == {2 * i + 1 for i in range(len(pairs))}


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, [len(s) for s in sets]


def test_minhash(odd, none):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == N
    by = {r.doc_id: r for r in out}
    assert by[2].component_id == 1 and not by[2].kept and by[3].component_id == 3 and by[3].n_shingles == 0
    assert by[None].component_id is None and by[None].kept
    assert by[8].n_shingles == 1 and by[12].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_crowds_of_near_copies_over_small_blocks(spark, monkeypatch):
    """A crowd that spans several blocks, whose members are linked only through others, by brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PACKED", 8)
    rng = np.random.default_rng(8)
    texts = []
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        for i in range(60 if g == 0 else 6):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 6))):
                w[at] = f"e{rng.integers(1e9)}"
            texts.append(" ".join(w).title() if i % 2 else " ".join(w))
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root, sizes = brute_components(texts, 4)
    assert [out[i].component_id for i in range(len(texts))] == root
    assert [out[i].n_shingles for i in range(len(texts))] == sizes


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = h[:2000], h[1000:]
    assert (minhash.merge(minhash.registers(a), minhash.registers(b)) == minhash.registers(h)).all()
    ra, rb = minhash.registers(a), minhash.registers(b)
    assert abs((ra == rb).mean() - 1 / 3) < 0.15
    far = minhash.could_reach(0.8, 2000, np.array([2000]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))
    same = minhash.could_reach(0.8, 2000, np.array([2000]), np.array([0]), np.array([0]))
    assert (far[0], same[0]) == (False, True)


def test_components(spark):
    rng = np.random.default_rng(10)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 0.5]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.5]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 0.0]), (203, [float("nan"), 1.0, 1.0]), (204, []), (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in vamana.nearest(df, df.filter("vec_id % 20 = 0"), shard=25).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120}
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 200 and v}
    for q, found in got.items():
        order = sorted((i for i in fine if i != q), key=lambda i: (-round(float(fine[i] @ fine[q]), 12), i))[:20]
        assert [f[1] for f in sorted(found)] == order
    assert vamana.nearest(df.limit(0), df, shard=25).count() == 0
    few = df.filter("vec_id < 5")
    assert vamana.nearest(few, few.filter("vec_id = 0")).count() == 4


def test_neighbours_of_mixed_lengths(spark):
    """The index's commonest length holds for queries too, even if most queries have another."""
    rng = np.random.default_rng(14)
    x = {i: rng.normal(size=3) for i in range(200)}
    rows = [(i, v[:2].tolist() if i % 20 == 0 and i < 120 else v.tolist()) for i, v in x.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vamana.nearest(df, df.filter("vec_id % 20 = 0"), shard=70).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {120, 140, 160, 180}
    fine = {i: np.array(v) for i, v in rows if len(v) == 3}
    for q, found in got.items():
        order = sorted((i for i in fine if i != q), key=lambda i: (-float(fine[i] @ fine[q]), i))[:20]
        assert [f[1] for f in sorted(found)] == order  # scores are exact in double precision
        assert all(s == pytest.approx(float(fine[i] @ fine[q]), abs=1e-15) for _, i, s in found)


def test_equal_scores_at_the_cut_of_a_shard(spark):
    """Many vectors score alike: those of the least ids are found, whatever the walk's order."""
    rows = [(i, [1.0, float(i % 2), float(i)]) for i in range(90)]
    q = [(1000, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + q, "vec_id long, embedding array<double>")
    found = [r.vec_id for r in vamana.nearest(df, df.filter("vec_id = 1000"), k=5, shard=200).orderBy("rank").collect()]
    assert found == [0, 1, 2, 3, 4]


def test_pipeline_stages(spark, odd, none, sf):
    """Nulls, repeated rows, empty tables and clashing names in every stage."""
    import corpus_pipeline as P

    for k, f in P.STAGES[:-1]:
        out = f(spark, odd, sf)
        assert out.columns == odd.columns, k
        assert f(spark, none, sf).count() == 0, k
        n = out.count()
        assert n <= N if k != "source mixing" else n <= 2 * N
    ids = sorted((r.doc_id for r in P.STAGES[2][1](spark, odd, sf).collect()), key=str)
    assert ids.count(8) == 2 and ids.count(None) == 1 and 2 not in ids  # equal ids are one document; rows without an id stay
    assert P.STAGES[-1][1](spark, odd, sf).count() == N and P.STAGES[-1][1](spark, none, sf).count() == 0


def test_digests_of_kept_words(odd):
    out = substring_dedup.remove_repeats(odd).withColumn("d", F.sha2("kept", 256)).collect()
    assert all(r.d == hashlib.sha256(r.kept.encode()).hexdigest() for r in out)


def test_blocks_by_columns_are_those_of_the_expression(spark):
    """Also where the smallest hashes repeat, and for lines without hashes."""
    rng = np.random.default_rng(5)
    lines = [[f"word{i}" for i in rng.integers(0, m, n)] for n in (9, 10, 12, 40, 257) for m in (2, 5, 1000)] + [["same"] * 30, ["a", "b", "c"] * 40, None]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, w array<string>").withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    for pct in (60, 80, 90):
        both = line_dedup.with_blocks(df, "h", pct).select("blocks", F.when(F.col("h").isNotNull(), line_dedup.simhash_blocks("h", pct)).alias("want"), "w", "h")
        assert all(r.blocks == r.want for r in both.collect())
    plan = line_dedup.with_blocks(df, "h", 90)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array(") == 1 and "transform(array(sort_array" not in plan


def test_keys_of_lines_are_dealt_out_before_they_are_counted(spark):
    """They are mostly different, so counting them first would only take time."""
    rows = [(i, f"{' '.join(f'w{j}' for j in range(20))} end{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    write = line_dedup.written
    line_dedup.written = lambda d, name: (seen.append((name, d._jdf.queryExecution().executedPlan().toString())), write(d, name))[1]
    try:
        gone, _ = line_dedup.duplicate_lines(df)
        assert sorted(r.ld_id for r in gone.collect()) == [1, 2, 3, 4, 5]
    finally:
        line_dedup.written = write
    plan = dict(seen)["members"]
    assert "REPARTITION_BY_COL" in plan


def test_lines_around_one_passage_do_not_all_meet(spark, monkeypatch):
    """Lines that share half their words but aren't alike meet by rare word pairs: all links are found, without the square of their number."""
    monkeypatch.setattr(line_dedup, "CROWD", 16)
    rng = np.random.default_rng(31)
    shared, n = [f"token{i}" for i in rng.integers(0, 400, 40)], 500
    lines = [[f"own{i}" for i in rng.integers(0, 3000, 20)] + shared + [f"own{i}" for i in rng.integers(0, 3000, 20)] for _ in range(n)]
    lines += [["so"] * 30 + [f"x{i}"] * 12 + ["and"] * 38 for i in range(10)]
    lines += [_edited(rng, lines[k], 1 + k % 8) for k in range(0, n, 10)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    seen, write = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda d, name: seen.setdefault(name, write(d, name)) if name == "rare" else write(d, name))
    gone = {r.ld_id for r in line_dedup.duplicate_lines(df)[0].collect()}
    assert gone == set(range(n + 10, n + 10 + n // 10))
    meeting = seen["rare"].groupBy("gram").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert 0 < meeting < 20 * n < n * (n - 1) / 8


def test_lines_of_few_words_have_as_many_blocks_as_their_edits_need(spark):
    """One more than an alike line's edits can change, by which each alike pair still meets: in every place, replaced, left out or put in."""
    rng = np.random.default_rng(41)
    lines = []
    for n in range(10, 30):
        for edits in range(1, n // 10 + 1):
            for _ in range(20):
                w = [f"token{i}" for i in rng.integers(0, 3000, n)]
                less, at = list(w), int(rng.integers(n))
                del less[at]
                lines += [(w, _edited(rng, w, edits)), (w, less), (w, [*w[:at], f"new{at}", *w[at:]])]
    lines = [(a, b) for a, b in lines if distance(a, b) <= 10 * max(len(a), len(b)) // 100]
    df = spark.createDataFrame([(i, "\n".join(" ".join(w) for w in p)) for i, p in enumerate(lines)], "doc_id long, text string")
    got, _ = line_dedup._line_table(df, 90, "doc_id", "text")
    blocks = {}
    for r in got.collect():
        blocks.setdefault(r.ld_id, []).append(set(r.blocks))
        assert len(r.blocks) <= min(10, 3 * (10 * r.n // 90) + 1)
    assert len(blocks) == len(lines) > 1000 and all(a & b for a, b in blocks.values())


def test_open_keys_of_lines_only_and_no_more_tables_than_needed(spark, monkeypatch):
    """Keys all of whose lines are of one group are done with; tables that nothing reads again go before the end; few lines don't move all texts."""
    from pathlib import Path

    rng = np.random.default_rng(43)
    done = [f"token{i}" for i in rng.integers(0, 3000, 40)]
    thirds = [[f"part{k}x{i}" for i in range(20)] for k in range(3)]  # alike in words, not in their order
    lines = [_edited(rng, done, 1) for _ in range(30)] + [[w for part in order for w in part] for order in itertools.permutations(thirds)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    rows, plans, write, at = {}, {}, line_dedup.written, {}

    def watched(d, name):
        plans.setdefault(name, d._jdf.queryExecution().executedPlan().toString())
        out = write(d, name)
        rows.setdefault(name, out.count())
        at.setdefault(name, out.written_at)
        return out

    monkeypatch.setattr(line_dedup, "written", watched)
    gone = {r.ld_id for r in line_dedup.duplicate_lines(df)[0].collect()}
    assert gone == set(range(1, 30))
    assert 0 < rows["crowds"] < rows["met"] / 4
    assert "BroadcastHashJoin" in plans["line-characters"]
    left = lambda name: Path(at[name].removeprefix("file:")).exists()
    assert left("line-keys") and not any(left(x) for x in ("members", "met", "near-pairs", "line-characters", "line-sights"))
