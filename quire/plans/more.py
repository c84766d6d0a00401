"""Queries of levels, continued boxes, tables, notes, tolerances and tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import book, more
from quire.operators import multisets as M
from quire.plans.audit import _CB, _CW, _J
from quire.plans.book import _UNITS, headings
from quire.plans.layout import REGIONS, T, W, blocks, regions, words
from quire.plans.registry import query
from quire.sources.tables import table


@query(f"""WITH {T}, {_UNITS}, z AS (SELECT t.block_id, t.doc_id, max(u.unit) AS unit, 8.0 + length(t.text) % 11 AS size FROM t LEFT JOIN u ON u.doc_id = t.doc_id AND u.first_page <= t.page WHERE t.kind = 'heading' AND t.text IS NOT NULL GROUP BY t.block_id, t.doc_id, t.text),
b AS (SELECT *, CAST(floor(ln(size) / ln(1.1)) AS BIGINT) AS bucket FROM z) SELECT block_id, CAST(least(dense_rank() OVER (PARTITION BY doc_id, unit ORDER BY bucket DESC) + 2, 6) AS INT) AS level FROM b""")
def chapter_levels(spark, sf):
    """Heading levels within units; sizes are made from the text's length."""
    h = headings(spark, sf)
    unit = book.unit_of(h.select("doc_id", "page", F.col("block_id").alias("key")), book.units(h))
    d = h.join(unit.withColumnRenamed("key", "block_id"), "block_id").select("doc_id", "unit", "block_id", (F.lit(8.0) + F.length("text") % 11).alias("size"))
    return more.chapter_levels(d)


@query(f"""WITH {REGIONS}, p AS (SELECT doc_id, page, min(y0) AS tp, max(y1) AS bt FROM r GROUP BY 1, 2), b AS (SELECT r.*, tp, bt, block_key % 2 AS fill FROM r JOIN p USING (doc_id, page)),
f AS (SELECT doc_id, page, fill, arg_max(block_key, struct_pack(a := y1, b := block_key)) AS box FROM b WHERE y1 >= bt - 0.2 * (bt - tp) GROUP BY ALL), h AS (SELECT doc_id, page - 1 AS page, fill, arg_min(block_key, struct_pack(a := y0, b := block_key)) AS next_box FROM b WHERE y0 <= tp + 0.2 * (bt - tp) GROUP BY doc_id, page - 1, fill)
SELECT doc_id, page, box, next_box FROM f JOIN h USING (doc_id, page, fill)""")
def continued_boxes(spark, sf):
    r = regions(words(spark, sf))
    p = r.groupBy("doc_id", "page").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    return more.continued(r.join(p, ["doc_id", "page"]).withColumn("fill", F.col("block_key") % 2).withColumnRenamed("block_key", "box"))


@query("""WITH c AS (SELECT p_partkey // 12 AS table_id, p_partkey % 12 // 4 AS row, p_partkey % 4 AS col, p_partkey % 12 < 4 AS header, '<' || CASE WHEN p_partkey % 12 < 4 THEN 'th' ELSE 'td' END || CASE WHEN p_partkey % 7 = 0 THEN ' rowspan="2"' ELSE '' END || '>' || p_name || '</' || CASE WHEN p_partkey % 12 < 4 THEN 'th' ELSE 'td' END || '>' AS x FROM part),
r AS (SELECT table_id, row, header, '<tr>' || string_agg(x, '' ORDER BY col) || '</tr>' AS x FROM c GROUP BY ALL) SELECT table_id, '<table>' || CASE WHEN count(*) FILTER (header) > 0 THEN '<thead>' || string_agg(x, '' ORDER BY row) FILTER (header) || '</thead>' ELSE '' END || '<tbody>' || coalesce(string_agg(x, '' ORDER BY row) FILTER (NOT header), '') || '</tbody></table>' AS xml FROM r GROUP BY 1""")
def table_xml(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(F.floor(k / 12).alias("table_id"), F.floor(k % 12 / 4).alias("row"), (k % 4).alias("col"), F.when(k % 7 == 0, 2).otherwise(1).alias("rowspan"), F.lit(1).alias("colspan"), (k % 12 < 4).alias("header"), F.col("p_name").alias("text"))
    return more.table_xml(c)


@query(f"""WITH {T}, n AS (SELECT block_id AS key, doc_id, page, ord, TRY_CAST(regexp_extract(text, '^\\s*([0-9]{{1,3}})[.)]?\\s', 1) AS INT) AS number FROM t WHERE text IS NOT NULL AND kind IN ('footnote', 'list_item')) SELECT key, number, coalesce(number = lag(number) OVER (PARTITION BY doc_id, page ORDER BY ord, key) + 1, false) AS follows FROM n WHERE number IS NOT NULL""")
def numbered_notes(spark, sf):
    b = blocks(spark, sf).where(F.col("text").isNotNull() & F.col("kind").isin("footnote", "list_item"))
    return more.numbered(b.select(F.col("block_id").alias("key"), "doc_id", "page", "ord", "text"))


@query(f"WITH {W}, {T}, {_CW}, {_CB}, {_J} SELECT doc_id, CAST(sum(abs(a - b)) AS BIGINT) AS differences, sum(abs(a - b)) <= greatest(3, sum(a) * 0.002) AS passed FROM j GROUP BY 1")
def second_reader_check(spark, sf):
    """Two readings of a document by characters: few differences are let pass."""
    a, b = M.characters(words(spark, sf), ["doc_id"]), M.characters(blocks(spark, sf), ["doc_id"])
    keys = ["doc_id", "c"]
    d = M.difference(a, b, keys).unionByName(M.difference(b, a, keys)).groupBy("doc_id").agg(F.sum("n").alias("d"))
    t = a.groupBy("doc_id").agg(F.sum("n").alias("t"))
    both = a.select("doc_id").unionByName(b.select("doc_id")).distinct().join(d, "doc_id", "left").join(t, "doc_id", "left")
    n = F.coalesce("d", F.lit(0))
    return both.select("doc_id", n.alias("differences"), more.within_tolerance(n, F.coalesce("t", F.lit(0))).alias("passed"))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY 1")
def tenant_scope(spark, sf):
    """Semi-join: only what the allowed owners have."""
    allowed = table(spark, sf, "customer").where(F.col("c_nationkey") < 10).select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf, "events").join(allowed, "user_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
