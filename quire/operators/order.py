"""Operators over the order of a document, in two steps so that a long document is no single task: pages are summed up
first, a window runs over pages, and another within each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, value: Column, name: str, order: list[str]) -> DataFrame:
    """Adds the greatest value of all rows before in (page, order) of the same doc_id; values are structs or scalars
    and may be null."""
    d = df.withColumn("_v", value)
    pages = d.groupBy("doc_id", "page").agg(F.max("_v").alias("_m"))
    before = F.max("_m").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.select("doc_id", "page", before.alias("_before"))
    here = F.max("_v").over(Window.partitionBy("doc_id", "page").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_here", here).join(pages, ["doc_id", "page"])
    return d.withColumn(name, F.when(F.col("_here").isNull() | (F.col("_before") > F.col("_here")), F.col("_before")).otherwise(F.col("_here"))).drop("_v", "_here", "_before")


def parents(headings: DataFrame, levels: int = 6) -> DataFrame:
    """``parent``: the nearest heading before of a higher rank; headings have doc_id, page, ord, block_id and level.

    The latest heading of each level is a running maximum; the parent is the latest of those above.
    """
    d = headings
    for k in range(1, levels):
        d = running_max(d, F.when(F.col("level") == k, F.struct("page", "ord", "block_id")), f"_l{k}", ["ord", "block_id"])
    above = [F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, levels)]
    return d.withColumn("parent", F.greatest(*above)["block_id"]).drop(*[f"_l{k}" for k in range(1, levels)])


def last_before(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """As-of: each row's latest mark at or before its page: ``key, mark``. Marks have doc_id, page and mark."""
    m = marks.groupBy("doc_id", "page").agg(F.max("mark").alias("_m"))
    pages = rows.select("doc_id", "page").distinct().join(m, ["doc_id", "page"], "full")
    at = F.last("_m", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(pages.select("doc_id", "page", at.alias("mark")), ["doc_id", "page"]).select("key", "mark")
