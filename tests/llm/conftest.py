import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and extra columns whose names clash with results."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "δέλτα", "the", "of", "x", "###", "don't"]
    long = " ".join(rng.choice(words) for _ in range(3000))
    line = "a line that is repeated in several documents of this table"
    rows = [
        (1, long, "en", "s1", None),
        (2, long, "en", "s1", 5),
        (3, None, None, None, None),
        (4, "", "en", "", 0),
        (5, " \t\n ", "fr", "s2", 5),
        (6, f"{line}\n{line}\nother words here", "fr", "s2", 5),
        (7, f"{line.upper()}\nsomething else entirely", "en", None, 5),
        (7, "the same id again", "en", None, 5),
        (8, "equal rows", "en", "s1", 5),
        (8, "equal rows", "en", "s1", 5),
        (None, f"no id\n{line}", "en", "s1", 5),
        (9, "no​space and ▁ mark 漢字 <|endoftext|> 😀", "zh", "s3", 5),
        (10, "1234 5678 !!", None, "s3", 5),
        (11, "word " * 400, "en", "s1", 5),
        (12, "x" * 5000, "en", "s1", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for c in ("label", "size", "kept", "n_words", "row", "path", "ids", "rule", "sim", "score", "removed", "Host", "decoded", "wd_row", "ld_id", "c0", "mx_row", "target", "node"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
