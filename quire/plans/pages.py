"""Queries on pages: headings by their look, running heads, labels, markers, ids, ledgers and job control."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import ledger, nested, pages
from quire.plans.jobs import _S, events
from quire.plans.layout import T, W, blocks, runs, words
from quire.plans.registry import query
from quire.sources.tables import table
from quire.streaming import jobs as J

_LOOKS = f"""{T}, r AS (SELECT block_id, size, sum(length(coalesce(text, ''))) AS n, bool_and(coalesce(bold, false)) AS b FROM aruns WHERE size IS NOT NULL GROUP BY 1, 2),
k AS (SELECT block_id, arg_max(size, struct_pack(a := n, b := size)) AS size, bool_and(b) AS bold FROM r GROUP BY 1), l AS (SELECT t.block_id, doc_id, kind, text, size, bold FROM t JOIN k USING (block_id) WHERE text IS NOT NULL),
z AS (SELECT doc_id, size, sum(length(text)) AS n FROM l GROUP BY 1, 2), y AS (SELECT doc_id, arg_max(size, struct_pack(a := n, b := size)) AS body FROM z GROUP BY 1)"""


def _looks(spark, sf):
    l = blocks(spark, sf).where(F.col("text").isNotNull()).join(pages.block_looks(runs(spark, sf)), "block_id").withColumn("chars", F.length("text"))  # noqa: E741
    return l.join(pages.body_sizes(l), "doc_id")


@query(f"WITH {_LOOKS} SELECT block_id, size, body FROM l JOIN y USING (doc_id) WHERE kind = 'paragraph' AND size >= 1.3 * body AND length(text) < 150 AND NOT regexp_matches(text, '[.]\\s*$') AND NOT regexp_matches(text, '^\\s*[0-9]+\\s*$')")
def promoted_headings(spark, sf):
    """Short large paragraphs that are headings."""
    l = _looks(spark, sf)  # noqa: E741
    return l.where((F.col("kind") == "paragraph") & pages.promoted(F.col("text"), F.col("size"), F.col("body"))).select("block_id", "size", "body")


@query(f"WITH {_LOOKS} SELECT block_id FROM l JOIN y USING (doc_id) WHERE length(text) <= 160 AND (size >= 1.15 * body OR (bold AND length(text) <= 80 AND NOT regexp_matches(text, '[.]\\s*$')))")
def guessed_headings(spark, sf):
    l = _looks(spark, sf)  # noqa: E741
    return l.where(pages.guessed(F.col("text"), F.col("size"), F.col("body"), F.col("bold"))).select("block_id")


@query(f"""WITH {T}, e AS (SELECT doc_id, page, trim(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '#', 'g')) AS key, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, block_id) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord DESC, block_id DESC) AS b FROM t),
c AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM e WHERE (a <= 2 OR b <= 2) AND key <> '' GROUP BY 1, 2), p AS (SELECT doc_id, count(DISTINCT page) AS n FROM t GROUP BY 1) SELECT doc_id, key, pages FROM c JOIN p USING (doc_id) WHERE pages >= greatest(3, 0.5 * n)""")
def compare_running_heads(spark, sf):
    return pages.running_lines(blocks(spark, sf))


@query(f"WITH {W}, p AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM w GROUP BY 1, 2) SELECT word_id FROM w JOIN p USING (doc_id, page) WHERE regexp_matches(text, '^\\s*[0-9]+\\s*$') AND (x1 <= l + 0.1 * (r - l) OR x0 >= r - 0.1 * (r - l))")
def margin_labels(spark, sf):
    return pages.margin_labels(words(spark, sf))


@query(f"WITH {T} SELECT block_id, kind[1] || '-' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY page, ord, block_id) AS id FROM t WHERE kind IN ('paragraph', 'heading', 'caption')")
def sequential_ids(spark, sf):
    return pages.numbered_in_order(blocks(spark, sf), ["paragraph", "heading", "caption"])


@query(f"WITH {W} SELECT word_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY floor(x0 / 20), y0, word_id) AS place FROM w")
def key_term_order(spark, sf):
    return pages.key_term_order(words(spark, sf))


_MARK = "^[(]?([0-9]{1,3}|[a-zA-Z])[.)]$|^[•▪■–*]$"


@query(f"""WITH {W}, m AS (SELECT * FROM w WHERE regexp_matches(text, '{_MARK}') AND y1 > y0 AND x1 >= x0),
c AS (SELECT m.word_id AS mark_id, w.word_id, w.x0 - m.x1 AS gap FROM m JOIN w ON m.doc_id = w.doc_id AND m.page = w.page AND m.word_id <> w.word_id AND w.x0 >= m.x1 AND w.x0 - m.x1 <= 4 * m.size AND (w.y0 + w.y1) / 2 BETWEEN m.y0 AND m.y1),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY gap, word_id) = 1) SELECT mark_id, word_id FROM f QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY gap, mark_id) = 1""")
def lone_markers(spark, sf):
    """List markers that stand alone and the word that each belongs to."""
    w = words(spark, sf)
    return pages.beside(w.where(F.col("text").rlike(_MARK)), w)


@query("SELECT family, size, count(*) FILTER (regexp_matches(text, '[?]')) AS hits, count(*) AS runs FROM aruns GROUP BY 1, 2 HAVING hits >= 2 AND hits >= 0.5 * runs")
def query_styles(spark, sf):
    """Styles that mostly carry questions to the author."""
    return pages.styles_of(runs(spark, sf), "[?]")


@query(f"WITH {T} SELECT block_id FROM t WHERE regexp_matches(text, '\\b(1[5-9]|20)[0-9][0-9]\\b') AND regexp_matches(text, '(pp?[.] ?[0-9]|[0-9]+ ?[-–] ?[0-9]+|\\([0-9]+\\)|doi|Press|Verlag)')")
def reference_like(spark, sf):
    return blocks(spark, sf).where(pages.reference_like(F.col("text"))).select("block_id")


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(text)), '{p}') THEN '{n}'" for n, p in pages.ROLES) + " ELSE 'box' END"


@query(f"WITH {T} SELECT block_id, {_ROLE} AS role FROM t WHERE kind = 'heading' AND text IS NOT NULL")
def box_roles(spark, sf):
    return blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull()).select("block_id", pages.box_role(F.col("text")).alias("role"))


@query(f"WITH {T}, f AS (SELECT block_id, text, regexp_extract(text, '^((?s:.*?)\\p{{Ll}}\\p{{Ll}}[.!?])(?:\\s|$)', 1) AS s FROM t WHERE text IS NOT NULL) SELECT block_id, length(CASE WHEN s = '' THEN text ELSE s END) AS chars FROM f")
def first_sentences(spark, sf):
    return blocks(spark, sf).where(F.col("text").isNotNull()).select("block_id", F.length(pages.first_sentence(F.col("text"))).alias("chars"))


@query("WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:https?://|www[.])[^\\s<>]+)', 1)) AS url FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, regexp_extract(lower(url), '^(?:https?://)?([^/:?#]+)', 1) AS h FROM u) SELECT doc_id, count(*) AS links, count(*) FILTER (h = 'a.example' OR h LIKE '%.a.example' OR h = 'example.org' OR h LIKE '%.example.org') AS allowed FROM h GROUP BY 1")
def allowed_links(spark, sf):
    """Links of each document and how many are on hosts of a list."""
    u = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:https?://|www[.])[^\s<>]+)"), 1)).alias("url"))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(pages.allowed_host(F.col("url"), ["a.example", "example.org"])).alias("allowed"))


@query("""WITH d AS (SELECT doc_id, n_chars % 101 AS score, CASE WHEN n_cells > 0 THEN (n_chars % 7) / 7.0 END AS numbers, n_cells % 3 AS missing FROM documents)
SELECT doc_id, concat_ws('; ', CASE WHEN score IS NULL THEN 'no text to compare' END, CASE WHEN score < 30 THEN 'compare by hand' END, CASE WHEN score >= 30 AND score < 60 THEN 'look at the differences' END, CASE WHEN numbers < 0.5 THEN 'check the numbers' END, CASE WHEN missing > 0 THEN 'look for missing pages' END) AS advice FROM d""")
def recommendations(spark, sf):
    """Every rule that holds; the figures are made from the documents' lengths."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 101).alias("s"), F.when(F.col("n_cells") > 0, F.col("n_chars") % 7 / 7.0).alias("n"), (F.col("n_cells") % 3).alias("m"))
    return d.select("doc_id", F.array_join(pages.recommendations(F.col("s"), F.col("n"), F.col("m")), "; ").alias("advice"))


@query(f"""WITH {T}, a AS (SELECT block_id, list_distinct(regexp_extract_all(lower(text), '\\pL+')) AS a FROM t WHERE text IS NOT NULL), j AS (SELECT block_id, string_agg(coalesce(text, ''), '' ORDER BY run_ix) AS x FROM aruns GROUP BY 1), b AS (SELECT block_id, list_distinct(regexp_extract_all(lower(x), '\\pL+')) AS b FROM j)
SELECT block_id, len(a) AS own, len(b) AS other, len(list_distinct(list_concat(a, b))) AS either FROM a JOIN b USING (block_id)""")
def keys_of_two_readings(spark, sf):
    """Words of a block's text, of its runs, and of both together."""
    keys = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"(\pL+)"), 1))
    j = runs(spark, sf).groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("x")).select("block_id", keys("x").alias("b"))
    a = blocks(spark, sf).where(F.col("text").isNotNull()).select("block_id", keys("text").alias("a"))
    return a.join(j, "block_id").select("block_id", F.size("a").alias("own"), F.size("b").alias("other"), F.size(F.array_union("a", "b")).alias("either"))


@query()
def missing_reasons(spark, sf):
    """Why blocks are missing from exports, by the ledger of their record."""
    return ledger.missing_reasons(nested.record_triples(table(spark, sf, "raw_records"), kinds=["dropped", "missing"]))


@query(f"WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, {_S} AS s FROM events), t AS (SELECT user_id, day, arg_min(s, struct_pack(t := ts, e := event_id)) AS s FROM e WHERE s IN ('done', 'failed') GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(t.s, 'failed') AS state FROM (SELECT DISTINCT user_id, day FROM e) LEFT JOIN t USING (user_id, day)")
def restart_recovery(spark, sf):
    return J.restarted(events(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, {_S} AS s FROM events), c AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS stop_at FROM events WHERE event_type = 'click' GROUP BY ALL), g AS (SELECT user_id, day, bool_or(s IN ('done', 'failed')) AS o, arg_max(s, struct_pack(a := ts, b := event_id)) AS state FROM e JOIN c USING (user_id, day) WHERE ts <= stop_at GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, state FROM g WHERE NOT o")
def cancelled_jobs(spark, sf):
    """The first click of a day stands for the order to stop."""
    e = events(spark, sf)
    orders = e.where(F.col("event_type") == "click").select("user_id", F.to_date("ts").alias("day"), F.col("ts").alias("at"))
    return J.cancelled(e, orders).withColumn("day", F.col("day").cast("string"))


@query("WITH t AS (SELECT event_type, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)) SELECT event_type, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us FROM t WHERE us IS NOT NULL GROUP BY 1")
def stage_timings(spark, sf):
    return J.stage_times(events(spark, sf))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS place FROM events")
def jobs_newest_first(spark, sf):
    return J.newest_first(events(spark, sf))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event\":\"' || event_type || '\"' || coalesce(',\"k\":\"' || json_extract_string(props, '$.k') || '\"', '') || '}' AS line FROM events")
def log_lines(spark, sf):
    return J.log_lines(events(spark, sf), ["k"])
