"""Joins between callouts, notes, bookmarks, ledgers and what they mean; grids; inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S


def callouts(texts: DataFrame) -> DataFrame:
    """``doc_id, key, label``: every callout in running text, with its normal key."""
    found = F.regexp_extract_all("text", F.lit(r"\b((?:Fig|Figure|Table|Abb)\.?\s*[0-9]+(?:\.[0-9]+)*[A-Z]?)"), 1)
    return texts.where(F.col("text").isNotNull()).select("doc_id", F.explode(found).alias("label")).withColumn("key", S.callout_key(F.col("label")))


def resolved(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, label, target``: callouts with the first target of their document and key, else of the key without its
    panel; null if there is none. Both sides are grouped before the join."""
    t = targets.groupBy("doc_id", "key").agg(F.min("target").alias("target"))
    plain = F.regexp_replace("key", r"\|[a-z]?$", "|")
    c = calls.groupBy("doc_id", "label", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("plain", plain)
    exact = c.join(t, ["doc_id", "key"], "left")
    loose = t.select("doc_id", F.col("key").alias("plain"), F.col("target").alias("loose"))
    return exact.join(loose, ["doc_id", "plain"], "left").select("doc_id", "label", F.coalesce("target", "loose").alias("target"), "n")


def within_pages(marks: DataFrame, headings: DataFrame, ahead: int = 3) -> DataFrame:
    """``mark, block_id``: the first heading on a bookmark's page or at most ``ahead`` pages on: an interval join made an
    equi-join by giving each mark the pages it may mean."""
    m = marks.select("mark", "doc_id", F.explode(F.sequence("page", F.col("page") + ahead)).alias("page"))
    met = m.join(headings.select("doc_id", "page", "ord", "block_id"), ["doc_id", "page"])
    return met.groupBy("mark").agg(F.min_by("block_id", F.struct("page", "ord", "block_id")).alias("block_id"))


def grid(cells: DataFrame) -> DataFrame:
    """``table_id, row, col, cell, clash``: the places that cells with spans occupy; where several do, the first holds it."""
    rows = F.explode(F.sequence("row", F.col("row") + F.greatest("rowspan", F.lit(1)) - 1)).alias("row")
    d = cells.select("table_id", "cell", "col", "colspan", rows)
    d = d.select("table_id", "cell", "row", F.explode(F.sequence("col", F.col("col") + F.greatest("colspan", F.lit(1)) - 1)).alias("col"))
    return d.groupBy("table_id", "row", "col").agg(F.min("cell").alias("cell"), (F.count(F.lit(1)) > 1).alias("clash"))


def ragged_rows(occupied: DataFrame) -> DataFrame:
    """``table_id, row, cells``: the cells of each row by column."""
    return occupied.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda s: s["cell"]).alias("cells"))


def line_groups(lines: DataFrame, gap: float = 0.5, differ: float = 0.6) -> DataFrame:
    """``doc_id, page, group, lines, x0, y0, x1, y1``: lines of a page in paragraphs: a new one where the gap exceeds
    ``gap`` sizes, sizes differ, or the lines don't share columns. Lines have line, size and a box."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    lag = lambda c: F.lag(c).over(w)
    new = lag("y1").isNull() | (F.col("y0") - lag("y1") > gap * F.col("size")) | (F.abs(F.col("size") - lag("size")) > differ) | (F.col("x0") >= lag("x1")) | (F.col("x1") <= lag("x0"))
    d = lines.withColumn("_n", F.when(new, 1).otherwise(0)).withColumn("group", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "page", "group").agg(F.count(F.lit(1)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def spanning_order(boxes: DataFrame, share: float = 0.75) -> DataFrame:
    """``doc_id, page, block_key, position``: two columns between boxes that span the page: bands from the top, the left
    column before the right in each."""
    page = boxes.groupBy("doc_id", "page").agg(F.min("x0").alias("_l"), F.max("x1").alias("_r"))
    b = boxes.join(page, ["doc_id", "page"]).withColumn("_wide", (F.col("x1") - F.col("x0")) > share * (F.col("_r") - F.col("_l")))
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "block_key")
    band = F.sum(F.when(F.col("_wide"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    side = F.when(F.col("_wide"), 0).when((F.col("x0") + F.col("x1")) / 2 < (F.col("_l") + F.col("_r")) / 2, 1).otherwise(2)
    d = b.withColumn("_band", band).withColumn("_side", side)
    return d.select("doc_id", "page", "block_key", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_band", "_side", "y0", "block_key")).alias("position"))


def islands(pages: DataFrame, flag: Column) -> DataFrame:
    """``doc_id, first_page, last_page, pages``: runs of consecutive pages on which the flag holds."""
    d = pages.where(flag)
    g = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return d.withColumn("_g", g).groupBy("doc_id", "_g").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages")).drop("_g")


def name_parts(name: Column) -> Column:
    """A person's name as credentials, surname and given: titles before and degrees behind go to the credentials; a comma
    puts the surname first, else the last word is it."""
    bare = F.trim(F.regexp_replace(name, r"\s+", " "))
    title = F.regexp_extract(bare, r"^((?:(?:Dr|Prof|Mr|Mrs|Ms|Ing|Sir)\.? )*)", 1)
    rest = F.regexp_replace(bare, r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Ing|Sir)\.? )*", "")
    degree = F.regexp_extract(rest, r",\s*((?:MD|MSc|PhD|BSc|MA|BA|eds?\.?)(?:,\s*(?:MD|MSc|PhD|BSc|MA|BA|eds?\.?))*)$", 1)
    rest = F.regexp_replace(rest, r"(?:,\s*(?:MD|MSc|PhD|BSc|MA|BA|eds?\.?))+$", "")
    comma = rest.contains(",")
    surname = F.when(comma, F.regexp_extract(rest, r"^([^,]*)", 1)).otherwise(F.regexp_extract(rest, r"(\S+)$", 1))
    given = F.when(comma, F.regexp_replace(rest, r"^[^,]*,\s*", "")).otherwise(F.regexp_replace(rest, r"\s*\S+$", ""))
    return F.struct(F.trim(F.concat(title, degree)).alias("credentials"), F.trim(surname).alias("surname"), F.trim(given).alias("given"))


def inventory(parts: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, page`` and a count of each kind of row on the page."""
    out = None
    for name, df in parts.items():
        one = df.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, ["doc_id", "page"], "full")
    return out.select("doc_id", "page", *[F.coalesce(n, F.lit(0)).alias(n) for n in parts])
