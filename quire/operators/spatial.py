"""Joins by place on the page. All are equi-joins on document, page and, where boxes meet, bands of the page's height."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import boxes as B

#: Height of a band in points.
BAND = 48


def banded(df: DataFrame, grow: float = 0.0) -> DataFrame:
    """A row for each band that a box, grown up and down, touches; ``_band`` is its number."""
    lo, hi = F.floor((F.col("y0") - grow) / BAND), F.floor((F.col("y1") + grow) / BAND)
    return df.withColumn("_band", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def best_block(words: DataFrame, blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``word_id, block_key``: each word's block of the greatest share, at least the threshold; null for orphans.

    Ties go to the smaller block, then to the smaller key. A word is tried in the one band of its centre, a block in
    all of its bands, so each pair meets at most once.
    """
    w = words.select("word_id", "doc_id", "page", B.box().alias("w"), F.floor((F.col("y0") + F.col("y1")) / 2 / BAND).alias("_band"))
    b = banded(blocks.select("doc_id", "page", "block_key", "x0", "y0", "x1", "y1")).select("doc_id", "page", "_band", "block_key", B.box().alias("b"))
    met = w.join(b, ["doc_id", "page", "_band"]).withColumn("share", B.share(F.col("w"), F.col("b"))).where(F.col("share") >= threshold)
    best = F.max_by("block_key", F.struct("share", (-B.area(F.col("b"))).alias("a"), (-F.col("block_key")).alias("k")))
    return w.select("word_id").join(met.groupBy("word_id").agg(best.alias("block_key")), "word_id", "left")


def nearest_block(orphans: DataFrame, blocks: DataFrame, reach: float = 0.6) -> DataFrame:
    """``word_id, block_key, gap``: each orphan's nearest block on its page within ``reach`` times its size."""
    grown = banded(orphans.withColumn("_r", F.col("size") * reach), 0.0).drop("_band")
    w = grown.dropDuplicates(["word_id"]).select("word_id", "doc_id", "page", "size", B.box().alias("w"), F.explode(F.sequence(F.floor((F.col("y0") - F.col("_r")) / BAND), F.floor((F.col("y1") + F.col("_r")) / BAND))).alias("_band"))
    b = banded(blocks.select("doc_id", "page", "block_key", "x0", "y0", "x1", "y1")).select("doc_id", "page", "_band", "block_key", B.box().alias("b"))
    met = w.join(b, ["doc_id", "page", "_band"]).withColumn("gap", B.distance(F.col("w"), F.col("b"))).where(F.col("gap") <= F.col("size") * reach)
    return met.groupBy("word_id").agg(F.min_by(F.struct("block_key", "gap"), F.struct("gap", "block_key")).alias("n")).select("word_id", "n.*")


def anchor_block(new: DataFrame, blocks: DataFrame) -> DataFrame:
    """``new_key, block_key``: as-of: the last block above on the page that shares columns, else the last block of the
    latest earlier page; null if there is none. What is joined within a page is bounded by what a page can hold."""
    n, b = new.alias("n"), blocks.alias("b")
    above = (
        n.join(b, (F.col("n.doc_id") == F.col("b.doc_id")) & (F.col("n.page") == F.col("b.page")))
        .where((F.col("b.y1") <= F.col("n.y0")) & (F.col("b.x0") < F.col("n.x1")) & (F.col("b.x1") > F.col("n.x0")))
        .groupBy(F.col("n.new_key").alias("new_key"))
        .agg(F.max_by("b.block_key", F.struct("b.y1", "b.block_key")).alias("same"))
    )
    # the last block of each page, and of the pages before it: the window runs over pages, one row each
    last = blocks.groupBy("doc_id", "page").agg(F.max(F.struct("y1", "block_key")).alias("l")).select("doc_id", "page", F.struct("page", F.col("l.block_key").alias("block_key")).alias("l"))
    pages = new.select("doc_id", "page").distinct().join(last, ["doc_id", "page"], "full")
    earlier = F.max("l").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    before = new.select("new_key", "doc_id", "page").join(pages.select("doc_id", "page", earlier.alias("e")), ["doc_id", "page"]).select("new_key", F.col("e.block_key").alias("before"))
    return new.select("new_key").join(above, "new_key", "left").join(before, "new_key", "left").select("new_key", F.coalesce("same", "before").alias("block_key"))


def contained(inner: DataFrame, frames: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``block_key, frame_key``: the first frame of the page that holds a block."""
    i = inner.select("doc_id", "page", "block_key", B.box().alias("i"), F.floor((F.col("y0") + F.col("y1")) / 2 / BAND).alias("_band"))
    f = banded(frames, tolerance).select("doc_id", "page", "_band", "frame_key", B.box().alias("f"))
    met = i.join(f, ["doc_id", "page", "_band"]).where(B.contains(F.col("f"), F.col("i"), tolerance))
    return met.groupBy("block_key").agg(F.min("frame_key").alias("frame_key"))


def unheld(things: DataFrame, holders: DataFrame, share: float = 0.5) -> DataFrame:
    """Anti-join: the things of which no holder covers the given share."""
    t = things.select("thing_key", "doc_id", "page", B.box().alias("t"), F.explode(F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))).alias("_band"))
    h = banded(holders).select("doc_id", "page", "_band", B.box().alias("h"))
    held = t.join(h, ["doc_id", "page", "_band"]).where(B.share(F.col("t"), F.col("h")) >= share).select("thing_key").distinct()
    return things.join(held, "thing_key", "left_anti")


def connected_lines(words: DataFrame) -> DataFrame:
    """``word_id, line``: words of a page in lines: sorted by top, a line ends where the gap to all before is positive."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "word_id")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("y0") >= before), 1).otherwise(0)
    return words.withColumn("_n", new).withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("word_id", "doc_id", "page", "line")
