"""Levels within chapters, boxes over a page turn, tables as XML, numbered notes, tolerances and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import html_escape


def chapter_levels(headings: DataFrame, start: int = 3, most: int = 6) -> DataFrame:
    """``block_id, level``: heading levels by size within each unit, sizes within a tenth as one; they begin at ``start``.

    Headings have doc_id, unit, block_id and size. The ranks run over the sizes of a unit, not over its headings."""
    by = headings.withColumn("bucket", F.floor(F.log(F.greatest("size", F.lit(1.0))) / F.log(F.lit(1.1))))
    sizes = by.select("doc_id", "unit", "bucket").distinct()
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "unit").orderBy(F.desc("bucket")))
    sizes = sizes.withColumn("level", F.least(rank + start - 1, F.lit(most)))
    return by.join(sizes, (by["doc_id"] == sizes["doc_id"]) & by["unit"].eqNullSafe(sizes["unit"]) & (by["bucket"] == sizes["bucket"])).select(by["block_id"], "level")


def continued(boxes: DataFrame, part: float = 0.2) -> DataFrame:
    """``doc_id, page, box, next_box``: boxes in the foot of a page that go on in the head of the next one, where both have
    the same fill. Boxes have doc_id, page, box, fill, y0, y1 and the page's top and bottom. The last and the first of a
    page are taken, so the join is one to one."""
    high = F.col("bottom") - F.col("top")
    foot = boxes.where(F.col("y1") >= F.col("bottom") - part * high).groupBy("doc_id", "page", "fill").agg(F.max_by("box", F.struct("y1", "box")).alias("box"))
    head = boxes.where(F.col("y0") <= F.col("top") + part * high).groupBy("doc_id", (F.col("page") - 1).alias("page"), "fill").agg(F.min_by("box", F.struct("y0", "box")).alias("next_box"))
    return foot.join(head, ["doc_id", "page", "fill"]).select("doc_id", "page", "box", "next_box")


def table_xml(cells: DataFrame) -> DataFrame:
    """``table_id, xml``: a table with its head of leading header rows and its body. Cells have table_id, row, col, rowspan,
    colspan, header and text; a table's cells are bounded by the table."""
    tag = F.when(F.col("header"), "th").otherwise("td")
    span = lambda c: F.when(F.col(c) > 1, F.concat(F.lit(f' {c}="'), F.col(c), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), html_escape(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("x", cell).groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "x"))), lambda s: s["x"]), "").alias("x"), F.bool_and("header").alias("h"))
    body = F.min(F.when(~F.col("h"), F.col("row"))).over(Window.partitionBy("table_id"))
    rows = rows.withColumn("head", body.isNull() | (F.col("row") < body)).withColumn("x", F.concat(F.lit("<tr>"), "x", F.lit("</tr>")))
    part = lambda head: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == head, F.struct("row", "x")))), lambda s: s["x"]), "")
    t = rows.groupBy("table_id").agg(part(True).alias("a"), part(False).alias("b"))
    return t.select("table_id", F.concat(F.lit("<table>"), F.when(F.col("a") != "", F.concat(F.lit("<thead>"), "a", F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), "b", F.lit("</tbody></table>")).alias("xml"))


def numbered(notes: DataFrame) -> DataFrame:
    """``key, number, follows``: the number that a note begins with and whether it is the one expected after the note before
    on the page. Notes have key, doc_id, page, ord and text."""
    n = notes.withColumn("number", F.regexp_extract("text", r"^\s*([0-9]{1,3})[.)]?\s", 1).try_cast("int")).where(F.col("number").isNotNull())
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "key")
    return n.select("key", "number", F.coalesce(F.col("number") == F.lag("number").over(w) + 1, F.lit(False)).alias("follows"))


def within_tolerance(differences: Column, total: Column, least: int = 3, share: float = 0.002) -> Column:
    """Whether so many differences of so many characters are let pass."""
    return differences <= F.greatest(F.lit(float(least)), total * share)


def advice(score: Column, numbers: Column) -> Column:
    """What to do about a comparison, the first rule that holds."""
    return F.when(score.isNull(), "no text to compare").when(numbers < 0.5, "check the numbers").when(score < 30, "compare by hand").when(score < 60, "look at the differences").otherwise("none")
