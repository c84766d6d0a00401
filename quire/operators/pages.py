"""Operators on pages: headings by their look, running heads, labels in the margin, markers beside text, order and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a heading looks against the body, for blocks that are promoted and for guesses of a comparison.
PROMOTED, PROMOTED_CHARS = 1.3, 150
GUESSED, GUESSED_CHARS, BOLD_CHARS = 1.15, 160, 80
#: Roles of boxes by their title, the first that fits.
ROLES = [("tip", r"^(tip|hint)\b"), ("warning", r"^(warning|caution|danger)\b"), ("note", r"^(note|remember)\b"), ("example", r"^(example|case)\b"), ("summary", r"^(summary|key points|key terms)\b"), ("exercise", r"^(exercise|question|activity)s?\b")]
_DIGITS = r"^\s*[0-9]+\s*$"


def block_looks(runs: DataFrame) -> DataFrame:
    """``block_id, size, bold``: the size that most letters of a block have and whether all of its runs are bold."""
    r = runs.where(F.col("size").isNotNull()).groupBy("block_id", "size").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n"), F.bool_and(F.coalesce("bold", F.lit(False))).alias("b"))
    return r.groupBy("block_id").agg(F.max_by("size", F.struct("n", "size")).alias("size"), F.bool_and("b").alias("bold"))


def body_sizes(looks: DataFrame) -> DataFrame:
    """``doc_id, body``: the size that most letters of a document's blocks have. Looks have doc_id, size and chars."""
    by = looks.groupBy("doc_id", "size").agg(F.sum("chars").alias("n"))
    return by.groupBy("doc_id").agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def promoted(text: Column, size: Column, body: Column) -> Column:
    """Whether a short large paragraph without a full stop is a heading."""
    return (size >= PROMOTED * body) & (F.length(text) < PROMOTED_CHARS) & ~text.rlike(r"[.]\s*$") & ~text.rlike(_DIGITS)


def guessed(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """Whether a block of a page looks like a heading, by its size or as bold text without a full stop."""
    return (F.length(text) <= GUESSED_CHARS) & ((size >= GUESSED * body) | (bold & (F.length(text) <= BOLD_CHARS) & ~text.rlike(r"[.]\s*$")))


def reference_like(text: Column) -> Column:
    """Whether a paragraph looks like an entry of a list of references: a year, and pages, a volume or a publisher's mark."""
    return text.rlike(r"\b(1[5-9]|20)[0-9][0-9]\b") & text.rlike(r"(pp?[.] ?[0-9]|[0-9]+ ?[-–] ?[0-9]+|\([0-9]+\)|doi|Press|Verlag)")


def box_role(title: Column) -> Column:
    """The role of a box by its title."""
    t = F.lower(F.trim(title))
    out = F.when(t.rlike(ROLES[0][1]), ROLES[0][0])
    for name, pattern in ROLES[1:]:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("box")


def running_lines(blocks: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """``doc_id, key, pages``: texts without their digits that stand among the first or last two of enough pages."""
    up, down = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id"), Window.partitionBy("doc_id", "page").orderBy(F.desc("ord"), F.desc("block_id"))
    edge = blocks.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where((F.col("a") <= 2) | (F.col("b") <= 2))
    key = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[0-9]+", "#"))
    counts = edge.withColumn("key", key).where(F.col("key") != "").select("doc_id", "page", "key").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("pages"))
    total = blocks.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("t"))
    return counts.join(total, "doc_id").where(F.col("pages") >= F.greatest(F.lit(float(least)), share * F.col("t"))).select("doc_id", "key", "pages")


def margin_labels(words: DataFrame, part: float = 0.1) -> DataFrame:
    """``word_id``: words of digits only that lie in the outer part of their page's width."""
    extent = words.groupBy("doc_id", "page").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    w = words.where(F.col("text").rlike(_DIGITS)).join(extent, ["doc_id", "page"])
    edge = part * (F.col("right") - F.col("left"))
    return w.where((F.col("x1") <= F.col("left") + edge) | (F.col("x0") >= F.col("right") - edge)).select("word_id")


def numbered_in_order(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """``block_id, id``: running ids of a document's kinds in reading order, such as p-12. Pages are summed up first, so
    that a long document is no single task."""
    own = blocks.where(F.col("kind").isin(kinds))
    pages = own.groupBy("doc_id", "kind", "page").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "kind").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("doc_id", "kind", "page").orderBy("ord", "block_id"))
    d = own.withColumn("here", here).join(pages.select("doc_id", "kind", "page", before.alias("before")), ["doc_id", "kind", "page"])
    return d.select("block_id", F.concat(F.substring("kind", 1, 1), F.lit("-"), F.col("before") + F.col("here")).alias("id"))


def key_term_order(words: DataFrame, step: float = 20.0) -> DataFrame:
    """``word_id, place``: the place of each word of a page by columns of ``step`` points, then from top to bottom."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.floor(F.col("x0") / step), "y0", "word_id")
    return words.select("word_id", F.row_number().over(w).alias("place"))


def beside(marks: DataFrame, words: DataFrame, reach: float = 4.0, band: float = 24.0) -> DataFrame:
    """``mark_id, word_id``: the nearest word to the right of each lone marker whose middle lies within the marker's
    height, at most ``reach`` times its size away; a word goes to its nearest marker. Joined by bands of the page."""
    m = marks.where((F.col("y1") > F.col("y0")) & (F.col("x1") >= F.col("x0"))).select(F.col("word_id").alias("mark_id"), "doc_id", "page", "size", F.col("x1").alias("right"), F.col("y0").alias("top"), F.col("y1").alias("bottom"), F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("band"))
    middle = (F.col("y0") + F.col("y1")) / 2
    w = words.select("word_id", "doc_id", "page", "x0", middle.alias("middle"), F.floor(middle / band).alias("band"))
    gap = F.col("x0") - F.col("right")
    met = m.join(w, ["doc_id", "page", "band"]).where((F.col("word_id") != F.col("mark_id")) & (gap >= 0) & (gap <= reach * F.col("size")) & F.col("middle").between(F.col("top"), F.col("bottom"))).withColumn("gap", gap)
    first = met.groupBy("mark_id").agg(F.min(F.struct("gap", "word_id")).alias("b")).select("mark_id", "b.*")
    return first.groupBy("word_id").agg(F.min(F.struct("gap", "mark_id")).alias("m")).select("m.mark_id", "word_id")


def styles_of(runs: DataFrame, pattern: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """``family, size, hits, runs``: the styles of which enough runs match a pattern."""
    s = runs.groupBy("family", "size").agg(F.count_if(F.coalesce(F.col("text").rlike(pattern), F.lit(False))).alias("hits"), F.count(F.lit(1)).alias("runs"))
    return s.where((F.col("hits") >= least) & (F.col("hits") >= share * F.col("runs")))


def first_sentence(text: Column) -> Column:
    """The text up to the first mark that follows two small letters, so that initials and short forms end nothing; all of
    it where there is none."""
    found = F.regexp_extract(text, r"^((?s:.*?)\p{Ll}\p{Ll}[.!?])(?:\s|$)", 1)
    return F.when(found == "", text).otherwise(found)


def allowed_host(url: Column, names: list[str]) -> Column:
    """Whether an address is on one of the hosts, or below one."""
    host = F.regexp_extract(F.lower(url), r"^(?:https?://)?([^/:?#]+)", 1)
    ends = [(host == n) | host.endswith("." + n) for n in names]
    out = ends[0]
    for e in ends[1:]:
        out = out | e
    return out


def recommendations(score: Column, numbers: Column, missing: Column) -> Column:
    """What to do about a comparison: every rule that holds, in their order."""
    rules = [(score.isNull(), "no text to compare"), (score < 30, "compare by hand"), ((score >= 30) & (score < 60), "look at the differences"), (numbers < 0.5, "check the numbers"), (missing > 0, "look for missing pages")]
    return F.array_compact(F.array(*[F.when(c, text) for c, text in rules]))
