"""Text from positioned words, and the classes and links of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import boxes as B


def joined_lines(words: DataFrame, lines: DataFrame, gap: float = 0.12) -> DataFrame:
    """``doc_id, page, line, text, hyphen``: the words of a line from left to right, with a space where the gap is wider
    than ``gap`` times the larger size; ``hyphen`` says that the line ends in a letter and a hyphen."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x0", "word_id")
    d = words.join(lines.select("word_id", "line"), "word_id")
    space = (F.col("x0") - F.lag("x1").over(w)) > gap * F.greatest("size", F.lag("size").over(w))
    d = d.withColumn("t", F.concat(F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), F.coalesce("text", F.lit(""))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "t"))), lambda s: s["t"]), "")
    by = d.groupBy("doc_id", "page", "line").agg(text.alias("text"))
    return by.withColumn("hyphen", F.col("text").rlike(r"\p{L}{2,}-$"))


def dehyphenated(lines: DataFrame) -> DataFrame:
    """``doc_id, page, line, text, taken``: a line that ends in a hyphen takes the first word of the next line of the page
    where that begins in lower case; the next line loses it."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    nxt, head = F.lead("text").over(w), F.regexp_extract(F.lead("text").over(w), r"^(\S+)", 1)
    d = lines.withColumn("_take", F.col("hyphen") & F.coalesce(nxt.rlike(r"^\p{Ll}"), F.lit(False))).withColumn("_head", head)
    d = d.withColumn("_given", F.coalesce(F.lag("_take").over(w), F.lit(False)))
    own = F.when(F.col("_given"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    return d.select("doc_id", "page", "line", F.when(F.col("_take"), F.concat(F.regexp_replace(own, "-$", ""), "_head")).otherwise(own).alias("text"), F.col("_take").alias("taken"))


def script(words: DataFrame, lines: DataFrame) -> DataFrame:
    """``word_id, script``: sup or sub for words below 0.85 of their line's size whose middle is off the line's."""
    by = words.join(lines.select("word_id", "line"), "word_id")
    base = by.groupBy("doc_id", "page", "line").agg(F.max("size").alias("_s"), F.median(F.when(F.col("size").isNotNull(), F.col("y1"))).alias("_b"))
    d = by.join(base, ["doc_id", "page", "line"])
    off = F.col("_b") - F.col("y1")
    return d.select("word_id", F.when((F.col("size") < 0.85 * F.col("_s")) & (off > 0.2 * F.col("_s")), "sup").when((F.col("size") < 0.85 * F.col("_s")) & (off < -0.08 * F.col("_s")), "sub").otherwise("").alias("script"))


def block_class(text: Column, size: Column, body: Column, bold: Column, mono: Column) -> Column:
    """A block's kind by its form: a caption by label at body size, a heading by size, a list item by marker, code by
    type, a short bold heading; else a paragraph."""
    caption = text.rlike(r"^\s*(Fig|Figure|Table|Tab|Abb|Tafel|Plate)[.]?\s*[0-9]") & (F.abs(size - body) <= 2)
    heading = (size >= 1.15 * body) & (F.length(text) < 200)
    item = text.rlike(r"^\s*([•‣▪–◦■*†‡-]|\(?[0-9]{1,3}[.)]|\(?[ivxlc]{1,6}[.)]|\(?[A-Za-z][.)])\s+")
    short = bold & (F.length(text) <= 80) & ~text.rlike(r"[.]\s*$")
    return F.when(caption, "caption").when(heading, "heading").when(item, "list_item").when(mono, "code").when(short, "heading").otherwise("paragraph")


# What headings of front and back matter are called.
MATTER = {
    "contents": "contents|table of contents|inhalt|inhaltsverzeichnis|table des matières|sommaire|índice|índice general|содержание|目次|目录",
    "preface": "preface|foreword|vorwort|préface|avant-propos|prefacio|prólogo|предисловие",
    "glossary": "glossary|glossar|glossaire|glosario",
    "index": "index|register|stichwortverzeichnis|índice alfabético|указатель|索引",
    "references": "references|bibliography|works cited|literatur|literaturverzeichnis|bibliographie|références|bibliografía|referencias",
    "acknowledgements": "acknowledge?ments|danksagung|remerciements|agradecimientos",
    "appendix": "appendix.*|anhang.*|annexe.*|anexo.*",
    "abstract": "abstract|summary|zusammenfassung|résumé|resumen",
    "notes": "notes|endnotes|anmerkungen",
}


def matter_kind(heading: Column) -> Column:
    """What a heading says its section is; null for an ordinary one. Letter-spaced text and numbers before don't matter."""
    t = F.regexp_replace(F.regexp_replace(F.trim(heading), r"^[0-9.]+\s+", ""), r"[.:\s]+$", "")
    t = F.lower(F.when(t.rlike(r"^(\S ){3,}\S$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(MATTER.items()):
        out = F.when(t.rlike(f"^({pattern})$"), kind).otherwise(out)
    return out


def page_class(text: Column) -> Column:
    """What a front page is by its text: copyright, dedication, epigraph, series, contents, title or other."""
    t = F.lower(text)
    return (
        F.when(t.rlike("isbn|copyright|©|all rights reserved"), "copyright").when(t.rlike("^\\s*(for|to|für|pour|para|à) [^.]{1,60}$"), "dedication")
        .when(t.rlike("[—–]\\s*\\p{L}[^.]{2,40}$") & t.rlike("[“\"«]"), "epigraph").when(t.rlike("series editor|other titles|in this series"), "series")
        .when(t.rlike("^\\s*(contents|inhalt|sommaire|índice)"), "contents").when(F.length(t) < 120, "title").otherwise("other")
    )


def flow_reason(text: Column, edge: Column) -> Column:
    """Why a block is kept out of the flow; null if it stays: watermarks, continued lines, running heads, author queries."""
    return (
        F.when(text.rlike(r"(?iu)^\s*(draft|confidential|proof|uncorrected|sample copy)[\s!.]*$"), "watermark").when(text.rlike(r"(?iu)\(?(continued|cont\.|fortsetzung|suite)\)?\s*$") & (F.length(text) < 80), "continued line")
        .when(text.rlike(r"(?iu)^\s*\[?(AQ|Q|author query)\s*[0-9]*\s*:"), "author query").when(edge & text.rlike(r"^\s*([0-9]{1,4}|[ivxlc]{1,7})\s*$"), "folio").when(edge & (F.length(text) < 60), "running head")
    )


def geometry(lines: DataFrame, page: DataFrame, tolerance: float = 2.0, centre: float = 3.0) -> DataFrame:
    """``doc_id, page, align, indent, n``: how lines stand on a page: justified, left, right or centre by the spread of
    their edges, and the median indent. Lines have x0 and x1."""
    by = lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("l"), F.max("x1").alias("r"), F.median("x0").alias("ml"), F.median("x1").alias("mr"), (F.max(F.col("x0") + F.col("x1")) - F.min(F.col("x0") + F.col("x1"))).alias("c"))
    left, right = (F.col("ml") - F.col("l")) <= tolerance, (F.col("r") - F.col("mr")) <= tolerance
    align = F.when(left & right & (F.col("n") >= 3), "justify").when(left, "left").when(F.col("c") / 2 <= centre, "center").when(right, "right").otherwise("left")
    return by.join(page.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select("doc_id", "page", align.alias("align"), F.round(F.col("ml") - F.col("l"), 4).alias("indent"), "n")


def two_columns(boxes: DataFrame, widths: tuple[float, float] = (0.18, 0.6), gap: float = 0.18) -> DataFrame:
    """``doc_id, page, columns``: 2 where blocks of a column's width gather around two middles apart, else 1."""
    page = boxes.groupBy("doc_id", "page").agg(F.min("x0").alias("l"), F.max("x1").alias("r"))
    b = boxes.join(page, ["doc_id", "page"]).withColumn("_w", (F.col("x1") - F.col("x0")) / F.greatest(F.col("r") - F.col("l"), F.lit(1.0)))
    b = b.where(F.col("_w").between(*widths)).withColumn("_m", ((F.col("x0") + F.col("x1")) / 2 - F.col("l")) / F.greatest(F.col("r") - F.col("l"), F.lit(1.0)))
    halves = b.groupBy("doc_id", "page").agg(F.count_if(F.col("_m") < 0.5).alias("a"), F.count_if(F.col("_m") >= 0.5).alias("b"), F.avg(F.when(F.col("_m") < 0.5, F.col("_m"))).alias("ma"), F.avg(F.when(F.col("_m") >= 0.5, F.col("_m"))).alias("mb"))
    two = (F.col("a") >= 2) & (F.col("b") >= 2) & (F.col("mb") - F.col("ma") > gap)
    return page.select("doc_id", "page").join(halves, ["doc_id", "page"], "left").select("doc_id", "page", F.when(two, 2).otherwise(1).alias("columns"))


def merged_rectangles(rects: DataFrame, slack: float = 1.0) -> DataFrame:
    """``doc_id, page, group, n, x0, y0, x1, y1``: rectangles of a page whose vertical ranges meet, as one box each."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "y1", "x0")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rects.withColumn("_n", F.when(before.isNull() | (F.col("y0") > before + slack), 1).otherwise(0)).withColumn("group", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "page", "group").agg(F.count(F.lit(1)).alias("n"), *B.union_aggregates())


def captions(captions_: DataFrame, floats: DataFrame, reach: float = 100.0) -> DataFrame:
    """``caption_key, float_key``: captions and floats of a page that are each other's nearest within reach: one to one."""
    c = captions_.select("doc_id", "page", "caption_key", B.box().alias("c"))
    f = floats.select("doc_id", "page", "float_key", B.box().alias("f"))
    met = c.join(f, ["doc_id", "page"]).withColumn("d", B.distance(F.col("c"), F.col("f"))).where(F.col("d") < reach)
    mine = F.row_number().over(Window.partitionBy("caption_key").orderBy("d", "float_key"))
    its = F.row_number().over(Window.partitionBy("float_key").orderBy("d", "caption_key"))
    return met.withColumn("_a", mine).withColumn("_b", its).where((F.col("_a") == 1) & (F.col("_b") == 1)).select("caption_key", "float_key")


def rejoined(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, first_block, n, text``: paragraphs that run on within a page as one: no end mark, and the next
    begins in lower case; a hyphen at the join goes."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id")
    t = F.regexp_replace("text", r"\s+\z", "")
    open_ = ~t.rlike(r"[.!?…:][\"”’»)]*$") & (F.col("kind") == "paragraph")
    goes_on = F.coalesce(F.lag(open_).over(w), F.lit(False)) & (F.col("kind") == "paragraph") & F.col("text").rlike(r"^\p{Ll}")
    d = blocks.where(F.col("text").isNotNull()).withColumn("_n", F.when(goes_on, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", t.alias("t")))), lambda s: s["t"]), " ")
    by = d.groupBy("doc_id", "page", "_g").agg(F.min_by("block_id", F.struct("ord", "block_id")).alias("first_block"), F.count(F.lit(1)).alias("n"), parts.alias("text"))
    return by.select("doc_id", "page", "first_block", "n", F.regexp_replace("text", r"(\p{L})- (\p{Ll})", "$1$2").alias("text"))


def score(parts: dict[str, tuple[Column, float]]) -> Column:
    """A weighted mean of the components that are there, from 0 to 100; null without any."""
    have = [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.values()]
    got = [F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()]
    total, weight = sum(got[1:], got[0]), sum(have[1:], have[0])
    return F.when(weight > 0, 100 * total / weight)
