"""Token counts with a digest cache.

A text's SHA-256 digest and the tokenizer file's digest are looked up in a stored table of counts; one text of each
distinct missing digest is encoded, its count appended, and all rows are answered from the table.

Within a task, counts of space-delimited stretches are remembered: a byte-level BPE tokenizer splits before a single
space between two other characters, so a text's count is the sum over such stretches, each counted by the library.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, _remove, pieces

_CUT = re.compile(r"(?<=\S) (?=\S)")
MEMO = 300_000  # stretches that a worker remembers
MEMO_CHARS = 40  # of the longest of them
BATCH_BYTES = 4 << 20  # of text whose new stretches are counted together


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Counter:
    """Counts tokens as the file's library does, without begin, end or added special tokens."""

    def __init__(self, path: str, memo: int = MEMO):
        self.memo = Memo(memo, MEMO_CHARS)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.many = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            pre = str(t.pre_tokenizer)
            # Only there is a text's count the sum over its stretches.
            self.cut = t.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre and all(" " not in a.content and not a.lstrip and not a.rstrip and not a.single_word for a in t.get_added_tokens_decoder().values())
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(e) for e in s.encode(texts, num_threads=1)]
            self.cut = False

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self.many(texts)
        split = []
        for t in texts:
            parts = _CUT.split(t)
            if len(parts) > 1:
                parts[1:] = [" " + p for p in parts[1:]]
            split.append(parts)
        known = self.memo.answers(split, self.many)
        return [sum(map(known.__getitem__, parts)) for parts in split]


@functools.lru_cache(1)
def _counter(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(path)


def _encode(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = _counter(path)
        for b in it:
            out = [n for _, texts in pieces(b.column("tc_text"), BATCH_BYTES) for n in c.counts([t or "" for t in texts])]
            yield pa.record_batch({"digest": b.column("tc_digest"), "n_tokens": pa.array(out, pa.int64())})

    return run


def cached_counts(spark, cache: str, version: str) -> DataFrame | None:
    """The stored (digest, n_tokens) of a tokenizer version; None if the table isn't there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(cache, "_SUCCESS")):
        return None
    return spark.read.schema("digest binary, n_tokens long, version string").parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row of df.

    A null text counts as an empty one. `cache` is a Parquet folder that all executors can write; it is created by
    the first call and appended to by later ones. Texts are compared as they are: this tokenizer's counts depend on
    every byte. Rows with equal texts, or equal ids, each get their row. An empty table gives no rows.
    """
    spark = df.sparkSession
    version = file_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id_col).alias("tc_id"), body.alias("tc_text"))
    digest = F.unhex(F.sha2("tc_text", 256))
    keys = docs.select("tc_id", F.octet_length("tc_text").cast("long").alias("n_bytes"), digest.alias("tc_digest"))
    wanted = keys.groupBy("tc_digest").agg(F.min(F.coalesce(F.col("tc_id").cast("string"), F.lit(""))).alias("tc_one"))
    known = cached_counts(spark, cache, version)
    if known is not None:
        wanted = wanted.join(known, F.col("tc_digest") == F.col("digest"), "left_anti")
    # One row's text of each distinct digest: the row is named by id and digest, so that no text is aggregated.
    misses = docs.withColumn("tc_digest", digest).withColumn("tc_one", F.coalesce(F.col("tc_id").cast("string"), F.lit(""))).join(wanted, ["tc_one", "tc_digest"], "left_semi")
    one = Window.partitionBy("tc_one", "tc_digest").orderBy("tc_digest")  # equal rows have equal texts: any of them will do
    misses = misses.withColumn("tc_n", F.row_number().over(one)).filter("tc_n = 1").select("tc_digest", "tc_text")
    fresh = misses.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long").withColumn("version", F.lit(version))
    fresh.write.mode("append").partitionBy("version").parquet(cache)  # readers of a version skip the others
    stored = cached_counts(spark, cache, version)
    out = keys.join(stored, F.col("tc_digest") == F.col("digest"), "left")
    return out.select(F.col("tc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def drop_cache(spark, cache: str) -> None:
    _remove(spark, cache)
