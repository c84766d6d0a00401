"""Body size, dominant formats, the style catalogue and heading levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size_bucket(size: Column) -> Column:
    """Half-point buckets, halves to the even neighbour."""
    return F.bround(size * 2, 0) / 2


def characters(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def body_size(words: DataFrame) -> DataFrame:
    """``doc_id, body_size, chars``: the half-point size that carries most characters; ties go to the size met first."""
    by = words.where(F.col("size").isNotNull()).groupBy("doc_id", size_bucket(F.col("size")).alias("body_size")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min(F.struct("page", "seq")).alias("first"))
    best = F.max_by(F.struct("body_size", "chars"), F.struct("chars", (-F.col("first.page")).alias("p"), (-F.col("first.seq")).alias("s")))
    return by.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def dominant_format(runs: DataFrame) -> DataFrame:
    """``block_id, family, size, bold, italic, chars`` of the format with most characters, sub- and superscripts
    left out; ties go to the greatest format."""
    own = runs.where(~F.coalesce("sup", F.lit(False)) & ~F.coalesce("sub", F.lit(False)))
    keys = ["family", "size", "bold", "italic"]
    by = own.groupBy("block_id", *keys).agg(F.sum(characters(F.col("text"))).alias("chars"))
    best = F.max_by(F.struct(*keys, "chars"), F.struct("chars", *keys))
    return by.groupBy("block_id").agg(best.alias("b")).select("block_id", "b.*")


def catalogue(formats: DataFrame) -> DataFrame:
    """``doc_id, family, size, bold, italic, chars, style``: the formats of a document by use, named body, s1, s2 and so on."""
    keys = ["family", "size", "bold", "italic"]
    by = formats.groupBy("doc_id", *keys).agg(F.sum("chars").alias("chars"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), *[F.asc_nulls_first(k) for k in keys]))
    return by.withColumn("style", F.when(n == 1, F.lit("body")).otherwise(F.concat(F.lit("s"), n - 1)))


def heading_levels(words: DataFrame, body: DataFrame, most: int = 6) -> DataFrame:
    """``doc_id, size, bold, level, usage, name``: levels by size, bold first, of what is larger than the body; a second
    format of a level gets a number by its use."""
    large = words.where(F.col("size").isNotNull()).select("doc_id", size_bucket(F.col("size")).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    by = large.join(body.select("doc_id", "body_size"), "doc_id").where(F.col("size") > F.col("body_size")).groupBy("doc_id", "size", "bold").agg(F.sum("n").alias("usage"))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), F.desc("bold")))
    leveled = by.withColumn("level", F.least(rank, F.lit(most)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy(F.desc("usage"), F.desc("size"), F.desc("bold")))
    return leveled.withColumn("name", F.concat(F.lit("h"), "level", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(F.lit(""))))


def differential(runs: DataFrame, base: DataFrame) -> DataFrame:
    """Runs keep only what differs from their block's format (null inherits); a size counts from half a point on, and
    never for sub- and superscripts."""
    b = base.select("block_id", *[F.col(c).alias(f"_{c}") for c in ("family", "size", "bold", "italic")])
    r = runs.join(b, "block_id", "left")
    script = F.coalesce("sup", F.lit(False)) | F.coalesce("sub", F.lit(False))
    return r.select(
        "block_id", "run_ix", "text",
        F.when(~F.col("family").eqNullSafe(F.col("_family")), F.col("family")).alias("family"),
        F.when(~script & (F.abs(F.col("size") - F.col("_size")) >= 0.5), F.col("size")).alias("size"),
        F.when(~F.col("bold").eqNullSafe(F.col("_bold")), F.col("bold")).alias("bold"),
        F.when(~F.col("italic").eqNullSafe(F.col("_italic")), F.col("italic")).alias("italic"),
        "sup", "sub",
    )


def absolute(runs: DataFrame, base: DataFrame) -> DataFrame:
    """The inverse: every run with its effective format."""
    b = base.select("block_id", *[F.col(c).alias(f"_{c}") for c in ("family", "size", "bold", "italic")])
    return runs.join(b, "block_id", "left").select("block_id", "run_ix", "text", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in ("family", "size", "bold", "italic")])


def coalesced(runs: DataFrame) -> DataFrame:
    """``block_id, run_ix, text, n``: neighbouring runs of one format as one; trailing white space of a block goes."""
    keys = ["family", "size", "bold", "italic", "sup", "sub"]
    w = Window.partitionBy("block_id").orderBy("run_ix")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    new = F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1)
    island = runs.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    by = island.groupBy("block_id", "_island").agg(F.min("run_ix").alias("run_ix"), text.alias("text"), F.count(F.lit(1)).alias("n"))
    last = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("run_ix"))) == 1
    return by.withColumn("text", F.when(last, F.rtrim("text")).otherwise(F.col("text"))).select("block_id", "run_ix", "text", "n")
