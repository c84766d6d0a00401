"""Queries over positioned words and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import boxes as B
from quire.operators import spatial, styles
from quire.plans.registry import query
from quire.sources.tables import latest, table

_WORD_VALUES = ["doc_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "font", "family", "size", "color", "bold", "italic", "mono", "upright"]


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Each word once, as last loaded."""
    return latest(table(spark, sf, "words"), ["word_id"], ["loaded_at"], _WORD_VALUES, ["doc_id", "page", "seq"])


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "aruns")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "text_blocks"), ["block_id"], ["loaded_at"], ["doc_id", "page", "ord", "kind", "text"], [])


def regions(w: DataFrame) -> DataFrame:
    """Boxes around the words of each third of an inch of a page, without their right fifth: the blocks that words fall
    into or stick out of, as the tables have no boxes of blocks."""
    by = w.where(F.col("x1") > F.col("x0")).withColumn("k", F.floor(F.col("y0") / 24)).groupBy("doc_id", "page", "k").agg(*B.union_aggregates(), F.count(F.lit(1)).alias("n"))
    return by.withColumn("x1", F.col("x0") + 0.8 * (F.col("x1") - F.col("x0"))).withColumn("block_key", F.col("page").cast("bigint") * 1000 + F.col("k"))


W = "w AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC NULLS LAST, doc_id DESC, page DESC, seq DESC) = 1)"
T = "t AS (SELECT * FROM text_blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
REGIONS = W + ", r0 AS (SELECT doc_id, page, CAST(floor(y0 / 24) AS BIGINT) AS k, * EXCLUDE (doc_id, page) FROM w WHERE x1 > x0), r AS (SELECT doc_id, page, k, min(x0) AS x0, min(y0) AS y0, min(x0) + 0.8 * (max(x1) - min(x0)) AS x1, max(y1) AS y1, CAST(page AS BIGINT) * 1000 + k AS block_key FROM r0 GROUP BY doc_id, page, k)"
SHARE = "greatest(least(w.x1, r.x1) - greatest(w.x0, r.x0), 0) * greatest(least(w.y1, r.y1) - greatest(w.y0, r.y0), 0) / ((w.x1 - w.x0) * (w.y1 - w.y0))"


@query(f"""WITH {W}, s AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS body_size, sum(length(coalesce(text, ''))) AS chars, min(page * 1000000 + seq) AS f FROM w WHERE size IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, body_size, CAST(chars AS BIGINT) AS chars FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, f) = 1""")
def body_size_mode(spark, sf):
    return styles.body_size(words(spark, sf))


_CHARS = "length(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]', '', 'g'))"


@query(f"""WITH s AS (SELECT block_id, family, size, bold, italic, CAST(sum({_CHARS}) AS BIGINT) AS chars FROM aruns WHERE NOT coalesce(sup, false) AND NOT coalesce(sub, false) GROUP BY ALL)
SELECT block_id, family, size, bold, italic, chars FROM s QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY chars DESC, family DESC NULLS LAST, size DESC NULLS LAST, bold DESC NULLS LAST, italic DESC NULLS LAST) = 1""")
def block_dominant_style(spark, sf):
    return styles.dominant_format(runs(spark, sf))


@query(f"""WITH {W}, s AS (SELECT doc_id, family, size, bold, italic, CAST(sum({_CHARS}) AS BIGINT) AS chars FROM w GROUP BY ALL)
SELECT *, CASE WHEN n = 1 THEN 'body' ELSE 's' || (n - 1) END AS style FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, family NULLS FIRST, size NULLS FIRST, bold NULLS FIRST, italic NULLS FIRST) AS n FROM s)""".replace("SELECT *, CASE", "SELECT doc_id, family, size, bold, italic, chars, CASE"))
def style_catalogue(spark, sf):
    w = words(spark, sf)
    return styles.catalogue(w.select("doc_id", "family", "size", "bold", "italic", styles.characters(F.col("text")).alias("chars")))


@query(f"""WITH {W}, s AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS z, sum(length(coalesce(text, ''))) AS chars, min(page * 1000000 + seq) AS f FROM w WHERE size IS NOT NULL GROUP BY 1, 2),
b AS (SELECT doc_id, z AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, f) = 1),
h AS (SELECT w.doc_id, round_even(size * 2, 0) / 2 AS size, coalesce(bold, false) AS bold, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS usage FROM w JOIN b USING (doc_id) WHERE round_even(size * 2, 0) / 2 > body GROUP BY ALL),
l AS (SELECT *, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC), 6) AS level FROM h)
SELECT doc_id, size, bold, CAST(level AS INT) AS level, usage, 'h' || level || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY usage DESC, size DESC, bold DESC) AS n FROM l)""")
def heading_tiers(spark, sf):
    w = words(spark, sf)
    return styles.heading_levels(w, styles.body_size(w)).select("doc_id", "size", "bold", "level", "usage", "name")


_D = "SELECT block_id, family, size, bold, italic, CAST(sum(" + _CHARS + ") AS BIGINT) AS chars FROM aruns WHERE NOT coalesce(sup, false) AND NOT coalesce(sub, false) GROUP BY ALL"
_D = f"d AS (SELECT * FROM ({_D}) QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY chars DESC, family DESC NULLS LAST, size DESC NULLS LAST, bold DESC NULLS LAST, italic DESC NULLS LAST) = 1)"


@query(f"""WITH {_D} SELECT a.block_id, a.run_ix, a.text, CASE WHEN a.family IS DISTINCT FROM d.family THEN a.family END AS family,
CASE WHEN NOT (coalesce(a.sup, false) OR coalesce(a.sub, false)) AND abs(a.size - d.size) >= 0.5 THEN a.size END AS size,
CAST(CASE WHEN a.bold IS DISTINCT FROM d.bold THEN a.bold END AS VARCHAR) AS bold, CAST(CASE WHEN a.italic IS DISTINCT FROM d.italic THEN a.italic END AS VARCHAR) AS italic, a.sup, a.sub FROM aruns a LEFT JOIN d USING (block_id)""")
def differential_runs(spark, sf):
    r = runs(spark, sf)
    return styles.differential(r, styles.dominant_format(r)).withColumns({c: F.col(c).cast("string") for c in ("bold", "italic")})


@query("SELECT block_id, run_ix, text, family, CAST(CASE WHEN coalesce(sup, false) OR coalesce(sub, false) THEN NULL ELSE bold END AS VARCHAR) AS bold, CAST(CASE WHEN coalesce(sup, false) OR coalesce(sub, false) THEN NULL ELSE italic END AS VARCHAR) AS italic FROM aruns")
def absolute_runs(spark, sf):
    """The round trip: differential and back; every run has its own format again."""
    r = runs(spark, sf)
    d = styles.dominant_format(r)
    back = styles.absolute(styles.differential(r, d), d)
    script = r.select("block_id", "run_ix", (F.coalesce("sup", F.lit(False)) | F.coalesce("sub", F.lit(False))).alias("s"))
    return back.join(script, ["block_id", "run_ix"]).select("block_id", "run_ix", "text", "family", F.when(~F.col("s"), F.col("bold")).cast("string").alias("bold"), F.when(~F.col("s"), F.col("italic")).cast("string").alias("italic"))


@query("""WITH a AS (SELECT *, CASE WHEN lag(run_ix) OVER o IS NULL THEN 1 WHEN family IS NOT DISTINCT FROM lag(family) OVER o AND size IS NOT DISTINCT FROM lag(size) OVER o AND bold IS NOT DISTINCT FROM lag(bold) OVER o AND italic IS NOT DISTINCT FROM lag(italic) OVER o AND sup IS NOT DISTINCT FROM lag(sup) OVER o AND sub IS NOT DISTINCT FROM lag(sub) OVER o THEN 0 ELSE 1 END AS nw FROM aruns WINDOW o AS (PARTITION BY block_id ORDER BY run_ix)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY block_id ORDER BY run_ix) AS isl FROM a),
g AS (SELECT block_id, min(run_ix) AS run_ix, string_agg(coalesce(text, ''), '' ORDER BY run_ix) AS text, count(*) AS n FROM i GROUP BY block_id, isl)
SELECT block_id, run_ix, CASE WHEN row_number() OVER (PARTITION BY block_id ORDER BY run_ix DESC) = 1 THEN rtrim(text, ' ') ELSE text END AS text, n FROM g""")
def coalesced_runs(spark, sf):
    return styles.coalesced(runs(spark, sf))


@query(f"""WITH {W}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text, x0, y0, font, size ORDER BY seq, word_id) AS n FROM w)
SELECT doc_id, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS removed FROM d GROUP BY doc_id""")
def overprint_dedupe(spark, sf):
    """Words set twice at one place: how many stay and go."""
    w = words(spark, sf)
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "text", "x0", "y0", "font", "size").orderBy("seq", "word_id"))
    return w.withColumn("n", first).groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("kept"), F.count_if(F.col("n") > 1).alias("removed"))


@query(f"""WITH {REGIONS}, m AS (SELECT w.word_id, r.block_key, {SHARE} AS s, (r.x1 - r.x0) * (r.y1 - r.y0) AS a FROM w JOIN r ON w.doc_id = r.doc_id AND w.page = r.page WHERE (w.x1 - w.x0) * (w.y1 - w.y0) > 0 AND {SHARE} >= 0.5),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY s DESC, a, block_key) = 1)
SELECT w.word_id, b.block_key FROM w LEFT JOIN b USING (word_id) WHERE (w.x1 - w.x0) * (w.y1 - w.y0) > 0""")
def word_block_best_overlap(spark, sf):
    w = words(spark, sf).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return spatial.best_block(w, regions(words(spark, sf)))


@query(f"""WITH {REGIONS}, o AS (SELECT * FROM w WHERE (x1 - x0) * (y1 - y0) > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE w.doc_id = r.doc_id AND w.page = r.page AND {SHARE} >= 0.5)),
m AS (SELECT w.word_id, r.block_key, greatest(r.x0 - w.x1, w.x0 - r.x1, 0) + greatest(r.y0 - w.y1, w.y0 - r.y1, 0) AS gap, w.size FROM o AS w JOIN r ON w.doc_id = r.doc_id AND w.page = r.page)
SELECT word_id, block_key, round(gap, 4) AS gap FROM m WHERE gap <= size * 0.6 QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY gap, block_key) = 1""")
def orphan_words_nearest(spark, sf):
    w = words(spark, sf).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    r = regions(words(spark, sf))
    orphans = w.join(spatial.best_block(w, r).where(F.col("block_key").isNull()).select("word_id"), "word_id")
    return spatial.nearest_block(orphans, r).withColumn("gap", F.round("gap", 4))


@query(f"""WITH {REGIONS}, n AS (SELECT word_id AS new_key, doc_id, page, x0, y0, x1, y1 FROM w WHERE (x1 - x0) * (y1 - y0) > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE w.doc_id = r.doc_id AND w.page = r.page AND {SHARE} >= 0.5)),
s AS (SELECT new_key, arg_max(r.block_key, struct_pack(y := r.y1, k := r.block_key)) AS same FROM n JOIN r ON n.doc_id = r.doc_id AND n.page = r.page WHERE r.y1 <= n.y0 AND r.x0 < n.x1 AND r.x1 > n.x0 GROUP BY 1),
l AS (SELECT doc_id, page, arg_max(block_key, struct_pack(y := y1, k := block_key)) AS k FROM r GROUP BY 1, 2),
b AS (SELECT new_key, arg_max(l.k, l.page) AS before FROM n JOIN l ON n.doc_id = l.doc_id AND l.page < n.page GROUP BY 1)
SELECT n.new_key, coalesce(same, before) AS block_key FROM n LEFT JOIN s USING (new_key) LEFT JOIN b USING (new_key)""")
def orphan_anchor_asof(spark, sf):
    """Words without a block, and the block that each would follow."""
    w = words(spark, sf)
    r = regions(w)
    full = w.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return spatial.anchor_block(spatial.unheld(full.withColumnRenamed("word_id", "thing_key"), r).withColumnRenamed("thing_key", "new_key"), r)


@query(f"""WITH {REGIONS}, f AS (SELECT doc_id, page, CAST(page AS BIGINT) * 1000 + k // 4 AS frame_key, min(x0) - 1 AS x0, min(y0) - 1 AS y0, max(x1) - 20 AS x1, max(y1) + 1 AS y1 FROM r GROUP BY doc_id, page, k // 4)
SELECT r.doc_id, r.block_key, min(f.frame_key) AS frame_key FROM r JOIN f ON r.doc_id = f.doc_id AND r.page = f.page AND r.x0 >= f.x0 - 3 AND r.y0 >= f.y0 - 3 AND r.x1 <= f.x1 + 3 AND r.y1 <= f.y1 + 3 GROUP BY 1, 2""")
def block_in_frame(spark, sf):
    r = regions(words(spark, sf))
    f = r.groupBy("doc_id", "page", F.floor(F.col("k") / 4).alias("q")).agg(*B.union_aggregates()).select("doc_id", "page", (F.col("page").cast("bigint") * 1000 + F.col("q")).alias("frame_key"), (F.col("x0") - 1).alias("x0"), (F.col("y0") - 1).alias("y0"), (F.col("x1") - 20).alias("x1"), (F.col("y1") + 1).alias("y1"))
    named = r.select("doc_id", "page", F.struct("doc_id", "block_key").alias("block_key"), "x0", "y0", "x1", "y1")
    return spatial.contained(named, f).select("block_key.doc_id", "block_key.block_key", "frame_key")


@query(f"""WITH {REGIONS} SELECT word_id FROM w WHERE (x1 - x0) * (y1 - y0) > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE w.doc_id = r.doc_id AND w.page = r.page AND {SHARE} >= 0.5)""")
def unheld_words_anti(spark, sf):
    w = words(spark, sf)
    return spatial.unheld(w.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumnRenamed("word_id", "thing_key"), regions(w)).select(F.col("thing_key").alias("word_id"))


@query(f"""WITH {REGIONS}, g AS (SELECT doc_id, page, block_key, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, block_key) AS gap, x0 < lag(x1) OVER (PARTITION BY doc_id, page ORDER BY y0, block_key) AND x1 > lag(x0) OVER (PARTITION BY doc_id, page ORDER BY y0, block_key) AS meets FROM r)
SELECT doc_id, block_key, CASE WHEN meets AND gap >= 0 THEN round(gap, 4) END AS space_before FROM g""")
def line_gap_space_before(spark, sf):
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "block_key")
    r = regions(words(spark, sf))
    gap = F.col("y0") - F.lag("y1").over(w)
    meets = (F.col("x0") < F.lag("x1").over(w)) & (F.col("x1") > F.lag("x0").over(w))
    return r.select("doc_id", "block_key", F.when(meets & (gap >= 0), F.round(gap, 4)).alias("space_before"))


@query(f"""WITH {W}, o AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR x0 > m + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, word_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT doc_id, page, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM i GROUP BY doc_id, page, g""")
def column_extents(spark, sf):
    """Union of horizontal intervals of a page's words; a gap above 2 points separates columns."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "x1", "word_id")
    m = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = words(spark, sf).withColumn("n", F.when(m.isNull() | (F.col("x0") > m + 2), 1).otherwise(0)).withColumn("g", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "page", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n")).drop("g")


@query(f"""WITH {W}, o AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)
SELECT word_id, doc_id, page, CAST(sum(CASE WHEN m IS NULL OR y0 >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM o""")
def word_lines(spark, sf):
    return spatial.connected_lines(words(spark, sf))


@query(f"""WITH {W} SELECT doc_id, page, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(median(size), 4) AS size, round(median(y1 - y0), 4) AS height FROM w GROUP BY 1, 2""")
def page_geometry(spark, sf):
    """The box around all words of a page, with median size and height."""
    return words(spark, sf).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), *B.union_aggregates(), F.round(F.median("size"), 4).alias("size"), F.round(F.median(F.col("y1") - F.col("y0")), 4).alias("height"))


@query(f"""WITH {W}, l AS (SELECT *, lag(seq) OVER (PARTITION BY doc_id, page ORDER BY seq, word_id) AS p FROM w)
SELECT doc_id, page, count(*) FILTER (seq > p + 1) AS gaps, count(*) FILTER (seq = p) AS doubled, max(seq) AS last FROM l GROUP BY 1, 2""")
def sequence_gaps(spark, sf):
    w = Window.partitionBy("doc_id", "page").orderBy("seq", "word_id")
    return words(spark, sf).withColumn("p", F.lag("seq").over(w)).groupBy("doc_id", "page").agg(F.count_if(F.col("seq") > F.col("p") + 1).alias("gaps"), F.count_if(F.col("seq") == F.col("p")).alias("doubled"), F.max("seq").alias("last"))


@query(f"""WITH {W}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq, word_id) AS i FROM w), m AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c)
SELECT doc_id, page, CAST(i AS INT) AS position FROM m WHERE seen IS NULL OR page > seen""")
def monotone_page_marks(spark, sf):
    """Where each page begins in the order of the words; pages are counted before the window over them."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    p = words(spark, sf).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    return p.select("doc_id", "page", (F.sum("n").over(w) - F.col("n") + 1).cast("int").alias("position"))


@query(f"""WITH {W} SELECT doc_id, page, seq, word_id, CAST(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY doc_id, page ORDER BY seq, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(coalesce(text, '')) - 1 AS BIGINT) AS start_char FROM w""")
def token_offsets(spark, sf):
    w = Window.partitionBy("doc_id", "page").orderBy("seq", "word_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length(F.coalesce("text", F.lit(""))) + 1
    return words(spark, sf).select("doc_id", "page", "seq", "word_id", (F.sum(n).over(w) - n).cast("bigint").alias("start_char"))


@query(f"""WITH {W} SELECT doc_id, count(*) AS words, count(DISTINCT page) AS pages, count(*) FILTER (text IS NULL) AS unmapped, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(*) FILTER (NOT upright) AS rotated FROM w GROUP BY 1""")
def triage_counts(spark, sf):
    return words(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("page").alias("pages"), F.count_if(F.col("text").isNull()).alias("unmapped"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(~F.col("upright")).alias("rotated"))


@query(f"""WITH {W}, p AS (SELECT doc_id, page, coalesce(sum(length(text)), 0) >= 20 AS full FROM w GROUP BY 1, 2) SELECT doc_id, count(*) AS pages, count(*) FILTER (p.full) AS text_pages, count(*) FILTER (p.full) >= 0.5 * count(*) AS born_digital FROM p GROUP BY 1""".replace("AS full FROM", 'AS "full" FROM').replace("p.full", 'p."full"'))
def triage_born_digital(spark, sf):
    p = words(spark, sf).groupBy("doc_id", "page").agg((F.coalesce(F.sum(F.length("text")), F.lit(0)) >= 20).alias("f"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("f").alias("text_pages")).withColumn("born_digital", F.col("text_pages") >= 0.5 * F.col("pages"))


@query(f"""WITH {W}, k AS (SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS key, CASE WHEN y0 < 76 THEN 'top' ELSE 'bottom' END AS edge, CAST(floor(y0 / 10) AS BIGINT) AS band, page FROM w WHERE text IS NOT NULL AND length(text) <= 120 AND (y0 < 76 OR y0 > 600)),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM w GROUP BY 1), g AS (SELECT doc_id, edge, key, band, count(DISTINCT page) AS seen FROM k GROUP BY ALL)
SELECT g.* FROM g JOIN n USING (doc_id) WHERE pages >= 2 AND seen >= CASE WHEN pages < 6 THEN greatest(2, pages / 2) ELSE greatest(3, pages / 3) END""")
def furniture_repeated_lines(spark, sf):
    """Texts that stand in the same place at the head or foot of many pages, digits masked."""
    w = words(spark, sf)
    edge = w.where(F.col("text").isNotNull() & (F.length("text") <= 120) & ((F.col("y0") < 76) | (F.col("y0") > 600)))
    g = edge.groupBy("doc_id", F.when(F.col("y0") < 76, "top").otherwise("bottom").alias("edge"), F.regexp_replace("text", "[0-9]+", "#").alias("key"), F.floor(F.col("y0") / 10).alias("band")).agg(F.countDistinct("page").alias("seen"))
    n = w.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    need = F.when(F.col("pages") < 6, F.greatest(F.lit(2.0), F.col("pages") / 2)).otherwise(F.greatest(F.lit(3.0), F.col("pages") / 3))
    return g.join(n, "doc_id").where((F.col("pages") >= 2) & (F.col("seen") >= need)).drop("pages")


@query(f"""WITH {W} SELECT family, CAST(count(*) AS BIGINT) AS words, count(DISTINCT doc_id) AS docs, count(DISTINCT font) AS fonts, max(size) AS largest FROM w GROUP BY 1""")
def font_usage(spark, sf):
    return words(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("font").alias("fonts"), F.max("size").alias("largest"))
