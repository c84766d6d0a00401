"""Queries of units, titles, links and the roll-up of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import book
from quire.plans.layout import T, blocks
from quire.plans.registry import query
from quire.sources.tables import table

_KIND = r"""CASE WHEN regexp_matches(trim(text, ' '), '(?i)^(chapter|ch\.|kapitel|глава|capítulo|chapitre)\s') OR regexp_matches(trim(text, ' '), '^第\s*[0-9]+\s*章') THEN 'chapter' WHEN regexp_matches(trim(text, ' '), '(?i)^(appendix|annexe|anhang|anexo)\b') THEN 'appendix' WHEN regexp_matches(trim(text, ' '), '(?i)^(part|teil|partie|parte)\s') THEN 'part' WHEN regexp_matches(trim(text, ' '), '(?i)^[0-9]+\.?\s+kapitel') THEN 'chapter' END"""
_UNITS = f"""h AS (SELECT doc_id, page, ord, block_id, {_KIND} AS kind, TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS INT) AS number FROM t WHERE kind = 'heading' AND text IS NOT NULL), f AS (SELECT * FROM h WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, block_id) = 1),
u AS (SELECT doc_id, CAST(row_number() OVER o AS INT) AS unit, kind, number, page AS first_page, lead(page) OVER o - 1 AS last_page FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY page))"""


def headings(spark, sf):
    return blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull())


@query(f"WITH {T}, {_UNITS} SELECT doc_id, unit, kind, coalesce(number, lag(number) OVER (PARTITION BY doc_id ORDER BY first_page) + 1) AS number, first_page, last_page FROM u")
def book_units(spark, sf):
    return book.units(headings(spark, sf)).select("doc_id", "unit", "kind", "number", "first_page", "last_page")


@query(f"WITH {T}, {_UNITS} SELECT t.block_id AS key, max(u.unit) AS unit FROM t LEFT JOIN u ON u.doc_id = t.doc_id AND u.first_page <= t.page WHERE t.kind = 'footnote' GROUP BY 1")
def unit_of_footnote(spark, sf):
    b = blocks(spark, sf).where(F.col("kind") == "footnote").select("doc_id", "page", F.col("block_id").alias("key"))
    return book.unit_of(b, book.units(headings(spark, sf)))


@query(f"WITH {T}, f AS (SELECT doc_id, arg_min(text, struct_pack(a := page, b := ord, c := block_id)) AS x FROM t WHERE kind = 'heading' AND text IS NOT NULL AND NOT regexp_matches(text, '^[0-9.\\s]*$') GROUP BY 1) SELECT m.doc_id, coalesce(max(title), max(x)) AS title FROM doc_meta m LEFT JOIN f USING (doc_id) GROUP BY 1")
def document_titles(spark, sf):
    return book.titles(table(spark, sf, "doc_meta"), headings(spark, sf))


@query(f"WITH {T} SELECT doc_id, page, count(*) AS lines, round(count(*) FILTER (regexp_matches(text, '(^|[\\s.…])([0-9]{{1,4}}|[ivxlc]{{1,7}})\\s*$')) / count(*), 6) AS share FROM t WHERE text IS NOT NULL GROUP BY 1, 2")
def contents_likelihood(spark, sf):
    return book.contents_likelihood(blocks(spark, sf).where(F.col("text").isNotNull()))


@query()
def text_links(spark, sf):
    return book.links(blocks(spark, sf).where(F.col("text").isNotNull()).select(F.col("block_id").alias("key"), "text"))


@query(f"""WITH {T}, d AS (SELECT DISTINCT doc_id FROM doc_meta), p AS (SELECT doc_id, bool_or(text IS NULL) AS f FROM t GROUP BY 1), m AS (SELECT doc_id, bool_or(title IS NULL OR lang IS NULL) AS f FROM doc_meta GROUP BY 1)
SELECT d.doc_id, 'text' AS "check", p.f AS failed FROM d LEFT JOIN p USING (doc_id) UNION ALL SELECT d.doc_id, 'metadata', m.f FROM d LEFT JOIN m USING (doc_id)""")
def completeness_rollup(spark, sf):
    m = table(spark, sf, "doc_meta")
    return book.completeness(m, {"text": blocks(spark, sf).select("doc_id", F.col("text").isNull().alias("failed")), "metadata": m.select("doc_id", (F.col("title").isNull() | F.col("lang").isNull()).alias("failed"))})
