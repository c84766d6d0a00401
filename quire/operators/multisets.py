"""Multisets as rows (keys, n): difference, intersection, sum, and the measures made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.select(*keys, F.col("n").alias("_a")), b.select(*keys, F.col("n").alias("_b"))
    return left.join(right, keys, "full").select(*keys, F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What a has more than b; both ways with the arguments exchanged."""
    return _joined(a, b, keys).where(F.col("_a") > F.col("_b")).select(*keys, (F.col("_a") - F.col("_b")).alias("n"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _joined(a, b, keys).select(*keys, F.least("_a", "_b").alias("n")).where(F.col("n") > 0)


def added(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _joined(a, b, keys).select(*keys, (F.col("_a") + F.col("_b")).alias("n"))


def f1(a: DataFrame, b: DataFrame, group: list[str], key: str) -> DataFrame:
    """``group, common, left, right, f1``: agreement of two multisets by group; 1 where both are empty."""
    j = _joined(a, b, [*group, key]).groupBy(*group).agg(F.sum(F.least("_a", "_b")).alias("common"), F.sum("_a").alias("left"), F.sum("_b").alias("right"))
    total = F.col("left") + F.col("right")
    return j.withColumn("f1", F.when(total > 0, 2 * F.col("common") / total).otherwise(1.0))


def profile_similarity(a: DataFrame, b: DataFrame, group: list[str], key: str) -> DataFrame:
    """``group, similarity``: 1 less the sum of differences over the sum of counts."""
    j = _joined(a, b, [*group, key]).groupBy(*group).agg(F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("d"), F.sum(F.col("_a") + F.col("_b")).alias("t"))
    return j.select(*group, F.when(F.col("t") > 0, 1 - F.col("d") / F.col("t")).otherwise(1.0).alias("similarity"))


def characters(texts: DataFrame, group: list[str]) -> DataFrame:
    """Counts of the characters of a text column, white space left out."""
    c = texts.where(F.col("text").isNotNull()).select(*group, F.explode(F.split(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", ""), "(?!^)")).alias("c")).where(F.col("c") != "")
    return counts(c, [*group, "c"])


def case_netted(missing: DataFrame, extra: DataFrame, group: list[str], key: str = "c") -> DataFrame:
    """What is missing after letters that came out in the other case are set off against each other."""
    swapped = F.when(F.upper(key) == F.col(key), F.lower(key)).otherwise(F.upper(key))
    other = extra.select(*group, swapped.alias(key), F.col("n").alias("_o")).groupBy(*group, key).agg(F.sum("_o").alias("_o"))
    return missing.join(other, [*group, key], "left").select(*group, key, (F.col("n") - F.least("n", F.coalesce("_o", F.lit(0)))).alias("n")).where(F.col("n") > 0)
