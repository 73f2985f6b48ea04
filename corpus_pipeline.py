"""A corpus pipeline of five operators: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece_codec
from fenmark.llm.common import written
from fenmark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the learned decision list reject.

    A null text fails, a null id doesn't matter, repeated rows share a verdict, and an empty table stays empty.
    """
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike lines only the first; a document that loses all its lines stays, with an empty text.

    Null texts stay null; null ids come after all others; rows with equal ids are one document, so that their lines at one
    place don't remove each other. An empty table stays empty.
    """
    out = line_dedup.without_duplicate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a similarity of 0.8 on five-word shingles.

    Rows without an id, or without words, stay. Rows with equal ids are one document and share their fate. An empty table stays empty.
    """
    gone = minhash.near_duplicates(docs, shingle=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words, null texts among them, are never taken.

    A null source is one more source, the last; null ids don't matter; repeated rows are taken alike. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, and the digest of what they decode to; a null text is encoded as an empty one."""
    return sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"), back=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("source mixing", mix), ("sentencepiece", encode)]
#: The stages learn rules, hash and follow a schedule: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
