"""Queries of the sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import matter, structure
from quire.plans.layout import blocks, regions, words
from quire.plans.registry import query
from quire.sources.tables import table


@query()
def visual_lines(spark, sf):
    return structure.visual_lines(words(spark, sf))


@query()
def xy_cut_order(spark, sf):
    return structure.xy_cut(regions(words(spark, sf)))


@query()
def list_nesting(spark, sf):
    items = blocks(spark, sf).where((F.col("kind") == "list_item") & F.col("text").isNotNull())
    return structure.list_nesting(items.select("doc_id", "page", "ord", "block_id", S.marker(F.col("text")).alias("marker"), F.lit(72.0).alias("x0")))


@query()
def ink_components(spark, sf):
    cells = words(spark, sf).where(F.col("x0").isNotNull() & F.col("y0").isNotNull()).select("doc_id", "page", F.floor(F.col("x0") / 9).cast("int").alias("x"), F.floor(F.col("y0") / 9).cast("int").alias("y")).distinct()
    return structure.ink_regions(cells)


def references(spark, sf):
    """Reference lines written from the bibliographic records."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "bibl") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    get = lambda p: F.get_json_object("payload", p)
    line = F.concat(get("$.authors[0].surname"), F.lit(", "), F.substring(F.coalesce(get("$.authors[0].given[0]"), F.lit("X")), 1, 1), F.lit(". ("), get("$.year"), F.lit("). "), get("$.title_a"), F.lit(". "), F.coalesce(get("$.publisher"), F.lit("Press")), F.lit(", "), F.coalesce(get("$.volume"), F.lit("1")), F.lit("."))
    return r.select("rec_id", get("$.year").alias("year"), get("$.title_a").alias("title"), line.alias("line")).where(F.col("line").isNotNull())


@query("""WITH r AS (SELECT * FROM raw_records WHERE kind = 'bibl' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1)
SELECT rec_id, json_extract_string(payload, '$.year') AS year, json_extract_string(payload, '$.title_a') AS title, coalesce(json_extract_string(payload, '$.volume'), '1') AS volume FROM r WHERE json_extract_string(payload, '$.authors[0].surname') IS NOT NULL AND json_extract_string(payload, '$.year') IS NOT NULL AND json_extract_string(payload, '$.title_a') IS NOT NULL""")
def reference_parse(spark, sf):
    """References written as text and read back: the fields of the record come out again."""
    f = matter.parsed(references(spark, sf), "line", matter.parse_reference)
    return f.select("rec_id", F.col("fields")["year"].alias("year"), F.col("fields")["title"].alias("title"), F.col("fields")["volume"].alias("volume"))


@query("""WITH r AS (SELECT * FROM raw_records WHERE kind = 'toc' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1)
SELECT rec_id, json_extract_string(payload, '$.title[0].text') AS title, json_extract_string(payload, '$.folio') AS folio FROM r WHERE json_extract_string(payload, '$.folio') IS NOT NULL AND regexp_matches(json_extract_string(payload, '$.title[0].text'), '^The ')""")
def contents_parse(spark, sf):
    """Contents lines written with leaders and read back."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "toc") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    title, folio = F.get_json_object("payload", "$.title[0].text"), F.get_json_object("payload", "$.folio")
    r = r.where(folio.isNotNull() & title.rlike("^The ")).select("rec_id", F.concat(F.lit("2.1 "), title, F.lit(" ..... "), folio).alias("line"))
    f = matter.parsed(r, "line", matter.parse_contents_line)
    return f.select("rec_id", F.col("fields")["title"].alias("title"), F.col("fields")["folio"].alias("folio"))


@query()
def glossary_lines(spark, sf):
    b = blocks(spark, sf).where((F.col("kind") == "caption") & F.col("text").isNotNull()).select("block_id", "text")
    f = matter.parsed(b, "text", matter.parse_glossary_line).where(F.col("fields").isNotNull())
    return f.select("block_id", F.col("fields")["term"].alias("term"), F.col("fields")["definition"].alias("definition"))


@query("""SELECT p_partkey, p_name AS term, (p_partkey % 90 + 1) || ',' || (p_partkey % 90 + 5) || '–' || (p_partkey % 90 + 8) AS locators, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS see_also FROM part""")
def index_parse(spark, sf):
    """Index entries written from parts and read back."""
    k = F.col("p_partkey") % 90
    line = F.concat(F.col("p_name"), F.lit(", "), k + 1, F.lit(", "), k + 5, F.lit("–"), k + 8, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(". See also "), F.col("p_brand"))).otherwise(F.lit("")))
    f = matter.parsed(table(spark, sf, "part").select("p_partkey", line.alias("line")), "line", matter.parse_index_line)
    return f.select("p_partkey", F.col("fields")["term"].alias("term"), F.col("fields")["locators"].alias("locators"), F.col("fields")["see_also"].alias("see_also"))


@query("""WITH d AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part) SELECT p_partkey, b || (10 - list_sum([CAST(substr(b, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10) % 10 AS isbn, CAST(1990 + p_partkey % 30 AS VARCHAR) AS year FROM d""")
def imprint_parse(spark, sf):
    """Imprints written with an ISBN and a year and read back."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")).alias("b"))
    line = F.concat(F.lit("Published by Mill Press, Town. © "), 1990 + F.col("p_partkey") % 30, F.lit(" Second edition. ISBN "), F.substring("b", 1, 3), F.lit("-"), F.substring("b", 4, 9), F.lit("-"), S.isbn_check_digit(F.col("b")))
    f = matter.parsed(p.select("p_partkey", line.alias("line")), "line", matter.parse_imprint)
    return f.select("p_partkey", F.col("fields")["isbn"].alias("isbn"), F.col("fields")["year"].alias("year"))


@query()
def fork_diff(spark, sf):
    """Documents and what they were forked from, by lines."""
    d = table(spark, sf, "documents").select("doc_id", "forked_from", "text")
    pairs = d.where(F.col("forked_from").isNotNull()).select(F.col("doc_id").alias("b"), F.col("forked_from").alias("a"), F.col("text").alias("text_b")).join(d.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return matter.diffs(pairs)
