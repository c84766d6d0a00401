"""Queries of sources and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import styles
from quire.plans.layout import T, W, blocks, runs, words
from quire.plans.registry import query
from quire.sources import readers, sinks
from quire.sources.tables import table

_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_X = _ESC.format("regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")


@query(f"WITH {T} SELECT block_id, doc_id, page, ord, kind, text FROM t")
def canonical_roundtrip(spark, sf):
    """Blocks as canonical JSON and read again."""
    b = blocks(spark, sf).select("block_id", "doc_id", "page", "ord", "kind", "text")
    return sinks.read_canonical(sinks.canonical_json(b, b.columns), b.schema)


@query(f"""WITH {T} SELECT block_id, '<' || e || ' id="b' || block_id || '" page="' || page || '">' || x || '</' || e || '>' AS xml FROM (SELECT *, CASE kind WHEN 'heading' THEN 'h' WHEN 'list_item' THEN 'li' WHEN 'footnote' THEN 'note' WHEN 'caption' THEN 'caption' ELSE 'p' END AS e, {_X} AS x FROM t)""")
def block_xml(spark, sf):
    return sinks.block_xml(blocks(spark, sf)).select("block_id", "xml")


@query(f"""WITH {T} SELECT block_id, '<' || e || '>' || CASE WHEN kind IN ('list_item', 'footnote', 'caption') THEN '<p>' || x || '</p>' ELSE x END || '</' || e || '>' AS xml FROM (SELECT *, CASE kind WHEN 'heading' THEN 'title' WHEN 'list_item' THEN 'list-item' WHEN 'footnote' THEN 'fn' WHEN 'caption' THEN 'caption' ELSE 'p' END AS e, {_X} AS x FROM t)""")
def publishing_xml(spark, sf):
    return sinks.block_xml(blocks(spark, sf), "publishing").select("block_id", "xml")


@query(f"""SELECT block_id, run_ix, CASE WHEN coalesce(sup, false) THEN '<sup>' || c || '</sup>' ELSE c END AS xml FROM (SELECT *, CASE WHEN coalesce(sub, false) THEN '<sub>' || b || '</sub>' ELSE b END AS c FROM (SELECT *, CASE WHEN coalesce(bold, false) THEN '<b>' || a || '</b>' ELSE a END AS b FROM (SELECT *, CASE WHEN coalesce(italic, false) THEN '<i>' || {_X} || '</i>' ELSE {_X} END AS a FROM aruns)))""")
def inline_xml(spark, sf):
    return sinks.run_xml(runs(spark, sf))


@query()
def style_css(spark, sf):
    w = words(spark, sf)
    return sinks.css(styles.catalogue(w.select("doc_id", "family", "size", "bold", "italic", styles.characters(F.col("text")).alias("chars"))))


@query(f"SELECT '<tr><td>' || {_ESC.format('doc_id')} || '</td><td>' || {_ESC.format(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} || '</td><td>' || coalesce(CAST(pages AS VARCHAR), '') || '</td></tr>' AS html FROM doc_meta")
def html_report(spark, sf):
    return sinks.html_table(table(spark, sf, "doc_meta"), ["doc_id", "title", "pages"])


@query(f"WITH {T} SELECT doc_id, CAST(page // 50 AS BIGINT) AS part, CAST(count(DISTINCT page) AS INT) AS pages FROM t GROUP BY 1, 2")
def epub_packages(spark, sf):
    return sinks.epub_packages(blocks(spark, sf)).select("doc_id", "part", "pages")


@query(f"WITH {W} SELECT doc_id, page, count(*) AS n FROM w WHERE page IN (1, 2, 3, 7) GROUP BY ALL")
def page_selection(spark, sf):
    return readers.select_pages(words(spark, sf), "1-3,7,2").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, pages <= 300 AND pages >= 1 AS accepted, CASE WHEN pages IS NULL OR pages < 1 THEN 'no pages' WHEN pages > 300 THEN 'too many pages' END AS reason FROM doc_meta")
def preflight(spark, sf):
    return readers.preflight(table(spark, sf, "doc_meta"), 300)
