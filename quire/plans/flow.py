"""Queries of lines, classes, matter and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import flow, multisets, spatial
from quire.plans.layout import REGIONS, T, W, blocks, regions, words
from quire.plans.audit import _CB, _CW, _J, _NUM
from quire.plans.registry import query
from quire.functions import scalars as S

_LINES = "lo AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w), ln AS (SELECT *, CAST(sum(CASE WHEN m IS NULL OR y0 >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM lo)"
_TEXT = _LINES + ", sp AS (SELECT *, CASE WHEN coalesce(x0 - lag(x1) OVER o > 0.12 * greatest(size, lag(size) OVER o), false) THEN ' ' ELSE '' END || coalesce(text, '') AS tt FROM ln WINDOW o AS (PARTITION BY doc_id, page, line ORDER BY x0, word_id)), lt AS (SELECT doc_id, page, line, string_agg(tt, '' ORDER BY x0, word_id) AS text FROM sp GROUP BY ALL)"


@query(f"WITH {W}, {_TEXT} SELECT doc_id, page, line, text, regexp_matches(text, '\\pL\\pL+-$') AS hyphen FROM lt")
def line_texts(spark, sf):
    w = words(spark, sf)
    return flow.joined_lines(w, spatial.connected_lines(w))


@query(f"""WITH {W}, {_TEXT}, hy AS (SELECT *, CASE WHEN line % 3 = 0 THEN regexp_replace(text, '\\W+$', '') || 'x-' ELSE lower(text) END AS t2 FROM lt), n AS (SELECT *, lead(t2) OVER o AS nx FROM hy WINDOW o AS (PARTITION BY doc_id, page ORDER BY line)),
k AS (SELECT *, regexp_matches(t2, '\\pL\\pL+-$') AND coalesce(regexp_matches(nx, '^\\p{{Ll}}'), false) AS take FROM n), g AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY doc_id, page ORDER BY line), false) AS given FROM k)
SELECT doc_id, page, count(*) AS lines, count(*) FILTER (take) AS taken, CAST(sum(length(CASE WHEN given THEN regexp_replace(t2, '^\\S+\\s*', '') ELSE t2 END) + CASE WHEN take THEN length(regexp_extract(nx, '^(\\S+)', 1)) - 1 ELSE 0 END) AS BIGINT) AS chars FROM g GROUP BY 1, 2""")
def space_hyphen_runs(spark, sf):
    """Lines that end in a hyphen and take the next word: every third line is given one, as the tables have none."""
    w = words(spark, sf)
    lines = flow.joined_lines(w, spatial.connected_lines(w))
    t = F.when(F.col("line") % 3 == 0, F.concat(F.regexp_replace("text", r"[^0-9A-Za-z_]+$", ""), F.lit("x-"))).otherwise(F.lower("text"))
    lines = lines.withColumn("text", t).withColumn("hyphen", F.col("text").rlike(r"\p{L}{2,}-$"))
    d = flow.dehyphenated(lines)
    return d.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.count_if("taken").alias("taken"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {W}, {_LINES}, b AS (SELECT doc_id, page, line, max(size) AS s, median(CASE WHEN size IS NOT NULL THEN y1 END) AS b FROM ln GROUP BY ALL) SELECT word_id, CASE WHEN size < 0.85 * s AND b - y1 > 0.2 * s THEN 'sup' WHEN size < 0.85 * s AND b - y1 < -0.08 * s THEN 'sub' ELSE '' END AS script FROM ln JOIN b USING (doc_id, page, line)")
def sup_sub(spark, sf):
    w = words(spark, sf)
    return flow.script(w, spatial.connected_lines(w))


@query(f"""WITH {T}, d AS (SELECT block_id, max(size) AS size, bool_or(coalesce(bold, false)) AS bold, bool_and(coalesce(mono, false)) AS mono FROM aruns GROUP BY 1)
SELECT block_id, CASE WHEN regexp_matches(text, '^\\s*(Fig|Figure|Table|Tab|Abb|Tafel|Plate)[.]?\\s*[0-9]') AND abs(size - 10.0) <= 2 THEN 'caption' WHEN size >= 11.5 AND length(text) < 200 THEN 'heading' WHEN regexp_matches(text, '^\\s*([•‣▪–◦■*†‡-]|\\(?[0-9]{{1,3}}[.)]|\\(?[ivxlc]{{1,6}}[.)]|\\(?[A-Za-z][.)])\\s+') THEN 'list_item' WHEN mono THEN 'code' WHEN bold AND length(text) <= 80 AND NOT regexp_matches(text, '[.]\\s*$') THEN 'heading' ELSE 'paragraph' END AS kind_of FROM t JOIN d USING (block_id) WHERE text IS NOT NULL""")
def block_classes(spark, sf):
    d = spark.read.parquet(f"{sf}/aruns.parquet").groupBy("block_id").agg(F.max("size").alias("size"), F.bool_or(F.coalesce("bold", F.lit(False))).alias("bold"), F.bool_and(F.coalesce("mono", F.lit(False))).alias("mono"))
    b = blocks(spark, sf).where(F.col("text").isNotNull()).join(d, "block_id")
    return b.select("block_id", flow.block_class(F.col("text"), F.col("size"), F.lit(10.0), F.col("bold"), F.col("mono")).alias("kind_of"))


@query(f"""WITH {T}, h AS (SELECT block_id, lower(regexp_replace(regexp_replace(trim(text, ' '), '^[0-9.]+\\s+', ''), '[.:\\s]+$', '')) AS x FROM t WHERE kind = 'heading' AND text IS NOT NULL)
SELECT block_id, CASE """ + " ".join(f"WHEN regexp_full_match(x, '({p})') THEN '{k}'" for k, p in flow.MATTER.items()) + " END AS matter FROM h")
def matter_kinds(spark, sf):
    return blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull()).select("block_id", flow.matter_kind(F.col("text")).alias("matter"))


@query(f"""WITH {T}, p AS (SELECT doc_id, page, lower(string_agg(text, ' ' ORDER BY ord, block_id)) AS x FROM t WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN regexp_matches(x, 'isbn|copyright|©|all rights reserved') THEN 'copyright' WHEN regexp_matches(x, '^\\s*(for|to|für|pour|para|à) [^.]{{1,60}}$') THEN 'dedication' WHEN regexp_matches(x, '[—–]\\s*\\pL[^.]{{2,40}}$') AND regexp_matches(x, '[“"«]') THEN 'epigraph' WHEN regexp_matches(x, 'series editor|other titles|in this series') THEN 'series' WHEN regexp_matches(x, '^\\s*(contents|inhalt|sommaire|índice)') THEN 'contents' WHEN length(x) < 120 THEN 'title' ELSE 'other' END AS class FROM p""")
def front_page_class(spark, sf):
    b = blocks(spark, sf).where(F.col("text").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))), lambda s: s["text"]), " ")
    return b.groupBy("doc_id", "page").agg(text.alias("x")).select("doc_id", "page", flow.page_class(F.col("x")).alias("class"))


@query(f"""WITH {T} SELECT block_id, CASE WHEN regexp_matches(text, '(?i)^\\s*(draft|confidential|proof|uncorrected|sample copy)[\\s!.]*$') THEN 'watermark' WHEN regexp_matches(text, '(?i)\\(?(continued|cont\\.|fortsetzung|suite)\\)?\\s*$') AND length(text) < 80 THEN 'continued line' WHEN regexp_matches(text, '(?i)^\\s*\\[?(AQ|Q|author query)\\s*[0-9]*\\s*:') THEN 'author query' WHEN ord % 50 = 0 AND regexp_matches(text, '^\\s*([0-9]{{1,4}}|[ivxlc]{{1,7}})\\s*$') THEN 'folio' WHEN ord % 50 = 0 AND length(text) < 60 THEN 'running head' END AS reason FROM t WHERE text IS NOT NULL""")
def flow_reasons(spark, sf):
    b = blocks(spark, sf).where(F.col("text").isNotNull())
    return b.select("block_id", flow.flow_reason(F.col("text"), F.col("ord") % 50 == 0).alias("reason"))


@query(f"""WITH {REGIONS}, a AS (SELECT doc_id, page, count(*) AS n, min(x0) AS l, max(x1) AS r, median(x0) AS ml, median(x1) AS mr, max(x0 + x1) - min(x0 + x1) AS c FROM r GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN ml - l <= 2 AND r - mr <= 2 AND n >= 3 THEN 'justify' WHEN ml - l <= 2 THEN 'left' WHEN c / 2 <= 3 THEN 'center' WHEN r - mr <= 2 THEN 'right' ELSE 'left' END AS align, round(ml - l, 4) AS indent, n FROM a""")
def paragraph_geometry(spark, sf):
    r = regions(words(spark, sf))
    return flow.geometry(r, r)


@query(f"""WITH {REGIONS}, p AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM r GROUP BY 1, 2), b AS (SELECT w.doc_id, w.page, (w.x1 - w.x0) / greatest(p.r - p.l, 1) AS wd, ((w.x0 + w.x1) / 2 - p.l) / greatest(p.r - p.l, 1) AS m FROM r AS w JOIN p USING (doc_id, page)),
h AS (SELECT doc_id, page, count(*) FILTER (m < 0.5) AS a, count(*) FILTER (m >= 0.5) AS b, avg(m) FILTER (m < 0.5) AS ma, avg(m) FILTER (m >= 0.5) AS mb FROM b WHERE wd BETWEEN 0.18 AND 0.6 GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN a >= 2 AND b >= 2 AND mb - ma > 0.18 THEN 2 ELSE 1 END AS columns FROM p LEFT JOIN h USING (doc_id, page)""")
def two_column_pages(spark, sf):
    return flow.two_columns(regions(words(spark, sf)))


@query(f"""WITH {REGIONS}, o AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), g AS (SELECT *, sum(CASE WHEN m IS NULL OR y0 > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, x0 ROWS UNBOUNDED PRECEDING) AS "group" FROM o)
SELECT doc_id, page, CAST("group" AS BIGINT) AS "group", count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY doc_id, page, "group\"""")
def merged_rectangles(spark, sf):
    return flow.merged_rectangles(regions(words(spark, sf)))


@query(f"""WITH {REGIONS}, c AS (SELECT doc_id, page, block_key AS caption_key, x0, y0, x1, y1 FROM r WHERE k % 2 = 1), f AS (SELECT doc_id, page, block_key AS float_key, x0, y0, x1, y1 FROM r WHERE k % 2 = 0),
m AS (SELECT c.doc_id, caption_key, float_key, greatest(f.x0 - c.x1, c.x0 - f.x1, 0) + greatest(f.y0 - c.y1, c.y0 - f.y1, 0) AS d FROM c JOIN f ON c.doc_id = f.doc_id AND c.page = f.page),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, caption_key ORDER BY d, float_key) AS a, row_number() OVER (PARTITION BY doc_id, float_key ORDER BY d, caption_key) AS b FROM m WHERE d < 100) SELECT doc_id, caption_key, float_key FROM n WHERE a = 1 AND b = 1""")
def caption_links(spark, sf):
    r = regions(words(spark, sf))
    key = F.struct("doc_id", "block_key")
    c = r.where(F.col("k") % 2 == 1).select("doc_id", "page", key.alias("caption_key"), "x0", "y0", "x1", "y1")
    f = r.where(F.col("k") % 2 == 0).select("doc_id", "page", key.alias("float_key"), "x0", "y0", "x1", "y1")
    return flow.captions(c, f).select("caption_key.doc_id", F.col("caption_key.block_key").alias("caption_key"), F.col("float_key.block_key").alias("float_key"))


@query(f"""WITH {T}, s AS (SELECT *, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+$', '') AS tr FROM t WHERE text IS NOT NULL), o AS (SELECT *, lag(NOT regexp_matches(tr, '[.!?…:]["”’»)]*$') AND kind = 'paragraph') OVER (PARTITION BY doc_id, page ORDER BY ord, block_id) AS op FROM s),
g AS (SELECT *, sum(CASE WHEN coalesce(op, false) AND kind = 'paragraph' AND regexp_matches(text, '^\\p{{Ll}}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord, block_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT doc_id, page, arg_min(block_id, struct_pack(a := ord, b := block_id)) AS first_block, count(*) AS n, regexp_replace(string_agg(tr, ' ' ORDER BY ord, block_id), '(\\pL)- (\\p{{Ll}})', '\\1\\2', 'g') AS text FROM g GROUP BY doc_id, page, g""")
def paragraphs_rejoined(spark, sf):
    return flow.rejoined(blocks(spark, sf))


@query(f"""WITH {W}, {T}, {_CW}, {_CB}, {_J}, p AS (SELECT doc_id, 1 - sum(abs(a - b)) / sum(a + b) AS chars FROM j GROUP BY 1),
na AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_NUM}, 1)) AS k FROM w WHERE text IS NOT NULL) GROUP BY ALL), nb AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_NUM}, 1)) AS k FROM t WHERE text IS NOT NULL) GROUP BY ALL),
nj AS (SELECT coalesce(na.doc_id, nb.doc_id) AS doc_id, coalesce(na.n, 0) AS x, coalesce(nb.n, 0) AS y FROM na FULL JOIN nb ON na.doc_id = nb.doc_id AND na.k = nb.k), f AS (SELECT doc_id, 2 * sum(least(x, y)) / (sum(x) + sum(y)) AS numbers FROM nj GROUP BY 1),
s AS (SELECT doc_id, 100 * (coalesce(chars, 0) * 20 + coalesce(numbers, 0) * 10) / (CASE WHEN chars IS NULL THEN 0 ELSE 20 END + CASE WHEN numbers IS NULL THEN 0 ELSE 10 END) AS score FROM p LEFT JOIN f USING (doc_id))
SELECT doc_id, round(score, 4) AS score, CASE WHEN score >= 60 THEN 'ok' WHEN score >= 30 THEN 'warn' ELSE 'error' END AS status FROM s""")
def compare_score(spark, sf):
    """Two readings of a document by characters and numbers, weighted over what is there."""
    w, b = words(spark, sf), blocks(spark, sf)
    chars = multisets.profile_similarity(multisets.characters(w, ["doc_id"]), multisets.characters(b, ["doc_id"]), ["doc_id"], "c").withColumnRenamed("similarity", "chars")
    numbers = lambda d: multisets.counts(d.where(F.col("text").isNotNull()).select("doc_id", F.explode(S.numbers(F.col("text"))).alias("k")), ["doc_id", "k"])
    f1 = multisets.f1(numbers(w), numbers(b), ["doc_id"], "k").select("doc_id", F.col("f1").alias("numbers"))
    s = chars.join(f1, "doc_id", "left").withColumn("score", flow.score({"chars": (F.col("chars"), 20.0), "numbers": (F.col("numbers"), 10.0)}))
    return s.select("doc_id", F.round("score", 4).alias("score"), F.when(F.col("score") >= 60, "ok").when(F.col("score") >= 30, "warn").otherwise("error").alias("status"))
