"""Reading of the Parquet tables and the removal of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str], ties: list[str] | None = None) -> DataFrame:
    """One row per key: of several deliveries the one greatest in ``order`` (nulls last), then in ``ties``, which are
    the values unless given.

    The limit of one row per key is also applied before the shuffle, so a key delivered very often never meets in one
    task, and only columns that are used later are read.
    """
    by = [F.col(c).desc_nulls_last() for c in [*order, *(values if ties is None else ties)]]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.select(*keys, *dict.fromkeys([*order, *values, *(ties or [])])).withColumn("_n", n).where(F.col("_n") == 1).select(*keys, *values)
