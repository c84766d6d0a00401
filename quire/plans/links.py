"""Queries of callouts, notes, bookmarks, ledgers, grids and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import boxes as B
from quire.functions import scalars as S
from quire.operators import book, links, spatial
from quire.plans.flow import _LINES
from quire.plans.layout import REGIONS, T, W, blocks, regions, words
from quire.plans.registry import query
from quire.sources.tables import table

_KEY = "lower(substr(regexp_extract(label, '^\\s*(\\pL+)', 1), 1, 3)) || '|' || regexp_extract(label, '([0-9]+(?:[.-][0-9]+)*)', 1) || '|' || lower(regexp_extract(label, '[0-9]([A-Za-z])\\b', 1))"


@query(f"""WITH {T}, c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b((?:Fig|Figure|Table|Abb)\\.?\\s*[0-9]+(?:\\.[0-9]+)*[A-Z]?)', 1)) AS label FROM t WHERE text IS NOT NULL AND kind <> 'caption'), ck AS (SELECT doc_id, label, {_KEY} AS key, count(*) AS n FROM c GROUP BY ALL),
g AS (SELECT doc_id, block_id, regexp_extract(text, '^\\s*((?:Fig|Table|Abb)[.]?\\s*[0-9]+(?:[.][0-9]+)*)', 1) AS label FROM t WHERE kind = 'caption' AND text IS NOT NULL), gk AS (SELECT doc_id, {_KEY} AS key, min(block_id) AS target FROM g WHERE label <> '' GROUP BY ALL)
SELECT ck.doc_id, ck.label, coalesce(a.target, b.target) AS target, n FROM ck LEFT JOIN gk a ON a.doc_id = ck.doc_id AND a.key = ck.key LEFT JOIN gk b ON b.doc_id = ck.doc_id AND b.key = regexp_replace(ck.key, '\\|[a-z]?$', '|')""")
def callout_targets(spark, sf):
    b = blocks(spark, sf).where(F.col("text").isNotNull())
    t = b.where(F.col("kind") == "caption").select("doc_id", "block_id", F.regexp_extract("text", r"^\s*((?:Fig|Table|Abb)[.]?\s*[0-9]+(?:[.][0-9]+)*)", 1).alias("label")).where(F.col("label") != "")
    t = t.select("doc_id", S.callout_key(F.col("label")).alias("key"), F.col("block_id").alias("target"))
    return links.resolved(links.callouts(b.where(F.col("kind") != "caption")), t)


@query(f"""WITH {T}, s AS (SELECT DISTINCT t.doc_id, trim(a.text, ' ') AS num FROM aruns a JOIN t USING (block_id) WHERE coalesce(a.sup, false) AND regexp_matches(trim(a.text, ' '), '^[0-9]+$')),
n AS (SELECT doc_id, regexp_extract(text, '^([0-9]+)\\s', 1) AS num, min(block_id) AS note FROM t WHERE kind = 'footnote' AND regexp_matches(text, '^[0-9]+\\s') GROUP BY ALL) SELECT s.doc_id, s.num, note FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.num = s.num""")
def note_links(spark, sf):
    """Superscript numbers and the footnotes of the document that begin with them."""
    b = blocks(spark, sf)
    runs = table(spark, sf, "aruns").where(F.coalesce("sup", F.lit(False))).select("block_id", F.trim("text").alias("num")).where(F.col("num").rlike("^[0-9]+$"))
    s = runs.join(b.select("block_id", "doc_id"), "block_id").select("doc_id", "num").distinct()
    n = b.where((F.col("kind") == "footnote") & F.col("text").rlike(r"^[0-9]+\s")).groupBy("doc_id", F.regexp_extract("text", r"^([0-9]+)\s", 1).alias("num")).agg(F.min("block_id").alias("note"))
    return s.join(n, ["doc_id", "num"], "left")


@query(f"""WITH {T}, r AS (SELECT rec_id, doc_id, TRY_CAST(json_extract_string(payload, '$.page') AS INT) AS page FROM raw_records WHERE kind = 'toc' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1)
SELECT r.rec_id AS mark, arg_min(t.block_id, struct_pack(a := t.page, b := t.ord, c := t.block_id)) AS block_id FROM r JOIN t ON t.doc_id = r.doc_id AND t.page BETWEEN r.page AND r.page + 25 WHERE t.kind = 'heading' GROUP BY 1""")
def bookmark_headings(spark, sf):
    r = table(spark, sf, "raw_records").where((F.col("kind") == "toc") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by(F.struct("doc_id", "payload"), F.struct("received_at", "payload")).alias("r"))
    m = r.select(F.col("rec_id").alias("mark"), "r.doc_id", F.get_json_object("r.payload", "$.page").try_cast("int").alias("page")).where(F.col("page").isNotNull())
    return links.within_pages(m, blocks(spark, sf).where(F.col("kind") == "heading"), 25)


_CELLS = "c AS (SELECT p_partkey // 12 AS table_id, p_partkey AS cell, CAST(p_partkey % 12 // 4 AS INT) AS row, CAST(p_partkey % 4 AS INT) AS col, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS rowspan, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS colspan FROM part), o AS (SELECT table_id, cell, unnest(range(row, row + rowspan)) AS row, col, colspan FROM c), g AS (SELECT table_id, cell, row, unnest(range(col, col + colspan)) AS col FROM o), k AS (SELECT table_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, min(cell) AS cell, count(*) > 1 AS clash FROM g GROUP BY ALL)"


def _cells(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(F.floor(k / 12).alias("table_id"), k.alias("cell"), F.floor(k % 12 / 4).cast("int").alias("row"), (k % 4).cast("int").alias("col"), F.when(k % 7 == 0, 2).otherwise(1).alias("rowspan"), F.when(k % 5 == 0, 2).otherwise(1).alias("colspan"))


@query(f"WITH {_CELLS} SELECT * FROM k")
def table_grid(spark, sf):
    """Cells with spans, made from keys, on their grid."""
    return links.grid(_cells(spark, sf))


@query(f"WITH {_CELLS} SELECT table_id, row, string_agg(CAST(cell AS VARCHAR), ' ' ORDER BY col) AS cells FROM k GROUP BY ALL")
def table_rows(spark, sf):
    return links.ragged_rows(links.grid(_cells(spark, sf))).withColumn("cells", F.array_join(F.transform("cells", lambda c: c.cast("string")), " "))


@query(f"""WITH {W}, {_LINES}, b AS (SELECT doc_id, page, line, max(size) AS size, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ln GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(y1) OVER o IS NULL OR y0 - lag(y1) OVER o > 0.5 * size OR abs(size - lag(size) OVER o) > 0.6 OR x0 >= lag(x1) OVER o OR x1 <= lag(x0) OVER o THEN 1 ELSE 0 END AS nw FROM b WINDOW o AS (PARTITION BY doc_id, page ORDER BY line)), g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM n)
SELECT doc_id, page, "group", count(*) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY doc_id, page, "group\"""")
def line_groups(spark, sf):
    w = words(spark, sf)
    lines = w.join(spatial.connected_lines(w).select("word_id", "line"), "word_id").groupBy("doc_id", "page", "line").agg(F.max("size").alias("size"), *B.union_aggregates())
    return links.line_groups(lines)


@query(f"""WITH {REGIONS}, p AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS rr FROM r GROUP BY 1, 2), b AS (SELECT r.*, x1 - x0 > 0.75 * (rr - l) AS wide, (x0 + x1) / 2 < (l + rr) / 2 AS lft FROM r JOIN p USING (doc_id, page)),
o AS (SELECT *, sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, block_key ROWS UNBOUNDED PRECEDING) AS band, CASE WHEN wide THEN 0 WHEN lft THEN 1 ELSE 2 END AS side FROM b)
SELECT doc_id, page, block_key, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, side, y0, block_key) AS INT) AS position FROM o""")
def spanning_order(spark, sf):
    return links.spanning_order(regions(words(spark, sf)))


@query(f"WITH {T}, p AS (SELECT doc_id, page, count(*) FILTER (regexp_matches(text, '(^|[\\s.…])([0-9]{{1,4}}|[ivxlc]{{1,7}})\\s*$')) / count(*) >= 0.05 AS f FROM t WHERE text IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p WHERE f) SELECT doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM g GROUP BY doc_id, g")
def contents_pages(spark, sf):
    """Runs of pages on which lines end in page numbers."""
    p = book.contents_likelihood(blocks(spark, sf).where(F.col("text").isNotNull()))
    return links.islands(p, F.col("share") >= 0.05)


_TI = "(?:(?:Dr|Prof|Mr|Mrs|Ms|Ing|Sir)\\.? )*"
_DG = "(?:MD|MSc|PhD|BSc|MA|BA|eds?\\.?)"


@query(f"""WITH n AS (SELECT DISTINCT name_id, trim(regexp_replace(contributor, '\\s+', ' ', 'g'), ' ') AS b FROM bib_names WHERE contributor IS NOT NULL), r AS (SELECT name_id, b, regexp_replace(b, '^{_TI}', '') AS r0 FROM n), q AS (SELECT *, regexp_replace(r0, '(?:,\\s*{_DG})+$', '') AS r1 FROM r)
SELECT name_id, trim(regexp_extract(b, '^({_TI})', 1) || regexp_extract(r0, ',\\s*({_DG}(?:,\\s*{_DG})*)$', 1), ' ') AS credentials, trim(CASE WHEN contains(r1, ',') THEN regexp_extract(r1, '^([^,]*)', 1) ELSE regexp_extract(r1, '(\\S+)$', 1) END, ' ') AS surname, trim(CASE WHEN contains(r1, ',') THEN regexp_replace(r1, '^[^,]*,\\s*', '') ELSE regexp_replace(r1, '\\s*\\S+$', '') END, ' ') AS given FROM q""")
def name_parts(spark, sf):
    n = table(spark, sf, "bib_names").where(F.col("contributor").isNotNull()).select("name_id", "contributor").distinct()
    return n.select("name_id", links.name_parts(F.col("contributor")).alias("p")).select("name_id", "p.*").distinct()


@query(f"""WITH {W}, {T}, a AS (SELECT doc_id, page, count(*) AS words FROM w GROUP BY 1, 2), b AS (SELECT doc_id, page, count(*) AS blocks FROM t GROUP BY 1, 2), n AS (SELECT doc_id, page, count(*) AS names FROM (SELECT DISTINCT name_id, doc_id, page FROM bib_names) GROUP BY 1, 2)
SELECT doc_id, page, coalesce(words, 0) AS words, coalesce(blocks, 0) AS blocks, coalesce(names, 0) AS names FROM a FULL JOIN b USING (doc_id, page) FULL JOIN n USING (doc_id, page)""")
def page_inventory(spark, sf):
    return links.inventory({"words": words(spark, sf), "blocks": blocks(spark, sf), "names": table(spark, sf, "bib_names").select("name_id", "doc_id", "page").distinct()})


@query("SELECT min(doc_id) AS first, count(*) AS copies, length(any_value(text)) AS chars FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(10)) <> '' GROUP BY sha256(text) HAVING count(*) > 1")
def same_content(spark, sf):
    """Documents of the same bytes: one row for each text with its copies."""
    d = table(spark, sf, "documents").where(F.col("text").isNotNull() & (F.regexp_replace("text", r"^[ \n]+|[ \n]+\z", "") != ""))
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("chars")).where(F.col("copies") > 1).drop("h")


@query(f"WITH {W} SELECT doc_id, CAST(floor(y0 / 10) AS BIGINT) AS band, size, color, count(DISTINCT page) AS pages FROM w WHERE color <> '#000000' GROUP BY ALL HAVING count(DISTINCT page) >= 3")
def repeated_decoration(spark, sf):
    """Coloured marks of one size in one place on three pages or more."""
    w = words(spark, sf).where(F.col("color") != "#000000")
    return w.groupBy("doc_id", F.floor(F.col("y0") / 10).alias("band"), "size", "color").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= 3)


@query(f"""WITH {T}, s AS (SELECT doc_id, count(*) FILTER (regexp_matches(lower(text), 'vol[.]|no[.]|doi')) AS j, count(*) FILTER (regexp_matches(lower(text), 'chapter|isbn|edition|kapitel')) AS b, count(*) FILTER (regexp_matches(lower(text), 'www[.]|https?:')) AS w FROM t WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, CASE WHEN j >= greatest(b, w) AND j > 0 THEN 'journal' WHEN b >= w AND b > 0 THEN 'book' WHEN w > 0 THEN 'web' ELSE 'other' END AS type FROM s""")
def publication_type(spark, sf):
    x = F.lower("text")
    s = blocks(spark, sf).where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.count_if(x.rlike("vol[.]|no[.]|doi")).alias("j"), F.count_if(x.rlike("chapter|isbn|edition|kapitel")).alias("b"), F.count_if(x.rlike("www[.]|https?:")).alias("w"))
    return s.select("doc_id", F.when((F.col("j") >= F.greatest("b", "w")) & (F.col("j") > 0), "journal").when((F.col("b") >= F.col("w")) & (F.col("b") > 0), "book").when(F.col("w") > 0, "web").otherwise("other").alias("type"))
