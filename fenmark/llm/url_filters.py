"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Each distinct (host, head of path) is expanded once, into every host suffix at a label boundary
and every path prefix whose length some rule has. Expressions meet rules on the first 32 bits of
a SHA-256 digest; the full digest confirms, and the longest rule wins (of equally long ones, a block).
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict (`default` if none fits).

    Null or malformed urls get an empty host and path and the default. Rules with a null or empty host fit
    nothing; a null path is an empty one. Columns of df named like the results, in whatever case, give way. Rows are kept as often as
    they occur. An empty rule table gives every row the default; empty input gives no rows.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).filter(F.length("r_host") > 0)
    shape = rules.agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"), F.max(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    # Distinct path lengths of rules: as many as the longest rule's path has characters at most.
    lengths, labels = shape["lengths"] or [0], shape["labels"] or 1
    mine, names = positional(df)
    out = mine.withColumns({"host": host_of(F.col(names[url])), "path": path_of(F.col(names[url]))})
    head = F.substring("path", 1, max(lengths))
    keys = out.select(F.col("host").alias("k_host"), head.alias("k_head")).filter(F.length("host") > 0).distinct()
    parts = F.split("k_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    expanded = (
        keys.withColumn("k_suffix", F.explode(suffixes))
        .withColumn("k_length", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .filter(F.col("k_length") <= F.length("k_head"))
        .withColumn("k_digest", F.sha2(F.concat("k_suffix", F.expr("substring(k_head, 1, k_length)")), 256))
        .withColumn("k_short", F.substring("k_digest", 1, 8))
    )
    known = (
        rules.withColumn("r_rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2("r_rule", 256))
        .groupBy("r_rule", "r_digest")
        .agg(F.max(F.col("r_verdict") == "block").alias("r_block"), F.max("r_verdict").alias("r_verdict"))
        .select("r_digest", F.substring("r_digest", 1, 8).alias("r_short"), F.struct(F.length("r_rule").alias("n"), "r_block", "r_rule", F.when(F.col("r_block"), "block").otherwise(F.col("r_verdict")).alias("v")).alias("r_best"))
    )
    best = (
        expanded.join(known, F.col("k_short") == F.col("r_short"))
        .filter(F.col("k_digest") == F.col("r_digest"))
        .groupBy("k_host", "k_head")
        .agg(F.max("r_best").alias("k_best"))
    )
    joined = out.join(best, (F.col("host") == F.col("k_host")) & (head == F.col("k_head")), "left")
    results = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("k_best.r_rule"), "verdict": F.coalesce(F.col("k_best.v"), F.lit(default))}
    return joined.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in results], *[v.alias(k) for k, v in results.items()])
