"""Queries of coverage, comparison, links and the audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import contents
from quire.operators import multisets as M
from quire.operators import nested
from quire.operators import order as O
from quire.plans.layout import T, W, blocks, runs, words
from quire.plans.registry import query
from quire.sources.tables import table

_BARE = "regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')"
_CW = f"cw AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_BARE}, '')) AS c FROM w WHERE text IS NOT NULL) WHERE c <> '' GROUP BY ALL)"
_CB = f"cb AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_BARE}, '')) AS c FROM t WHERE text IS NOT NULL) WHERE c <> '' GROUP BY ALL)"
_J = "j AS (SELECT coalesce(cw.doc_id, cb.doc_id) AS doc_id, coalesce(cw.c, cb.c) AS c, coalesce(cw.n, 0) AS a, coalesce(cb.n, 0) AS b FROM cw FULL JOIN cb ON cw.doc_id = cb.doc_id AND cw.c = cb.c)"


def _both(spark, sf):
    return M.characters(words(spark, sf), ["doc_id"]), M.characters(blocks(spark, sf), ["doc_id"])


@query(f"WITH {W}, {T}, {_CW}, {_CB}, {_J} SELECT doc_id, c, 'missing' AS side, a - b AS n FROM j WHERE a > b UNION ALL SELECT doc_id, c, 'extra', b - a FROM j WHERE b > a")
def char_coverage_multiset(spark, sf):
    """Characters that one reading of a document has more than the other."""
    a, b = _both(spark, sf)
    keys = ["doc_id", "c"]
    return M.difference(a, b, keys).withColumn("side", F.lit("missing")).unionByName(M.difference(b, a, keys).withColumn("side", F.lit("extra"))).select("doc_id", "c", "side", "n")


@query(f"WITH {W}, {T}, {_CW}, {_CB}, {_J} SELECT doc_id, CAST(sum(least(a, b)) AS BIGINT) AS common, CAST(sum(a) AS BIGINT) AS total, round(sum(least(a, b)) / sum(a), 6) AS ratio FROM j GROUP BY 1 HAVING sum(a) > 0")
def coverage_ratio(spark, sf):
    a, b = _both(spark, sf)
    c = M.intersection(a, b, ["doc_id", "c"]).groupBy("doc_id").agg(F.sum("n").alias("k"))
    return a.groupBy("doc_id").agg(F.sum("n").alias("total")).join(c, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(0)).alias("common"), "total", F.round(F.coalesce("k", F.lit(0)) / F.col("total"), 6).alias("ratio"))


@query(f"WITH {W} SELECT doc_id, page, CAST(sum(length({_BARE})) AS BIGINT) AS chars, CAST(grouping(page) AS INT) AS whole FROM w WHERE text IS NOT NULL GROUP BY GROUPING SETS ((doc_id, page), (doc_id))")
def char_coverage_by_page(spark, sf):
    w = words(spark, sf).where(F.col("text").isNotNull()).withColumn("k", F.length(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", "")))
    return w.groupingSets([["doc_id", "page"], ["doc_id"]], "doc_id", "page").agg(F.sum("k").alias("chars"), F.grouping("page").cast("int").alias("whole"))


@query(f"""WITH {W}, {T}, {_CW}, {_CB}, {_J}, m AS (SELECT doc_id, c, a - b AS n FROM j WHERE a > b), e AS (SELECT doc_id, CASE WHEN upper(c) = c THEN lower(c) ELSE upper(c) END AS c, CAST(sum(b - a) AS BIGINT) AS o FROM j WHERE b > a GROUP BY 1, 2)
SELECT m.doc_id, m.c, n - least(n, coalesce(o, 0)) AS n FROM m LEFT JOIN e ON m.doc_id = e.doc_id AND m.c = e.c WHERE n - least(n, coalesce(o, 0)) > 0 AND ord(m.c) < 128""")
def case_netting(spark, sf):
    a, b = _both(spark, sf)
    keys = ["doc_id", "c"]
    return M.case_netted(M.difference(a, b, keys), M.difference(b, a, keys), ["doc_id"]).where(F.ascii("c") < 128)


_NUM = "'([0-9]+(?:[.,][0-9]+)*)'"


@query(f"""WITH {W}, {T}, a AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_NUM}, 1)) AS k FROM w WHERE text IS NOT NULL) GROUP BY ALL), b AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_NUM}, 1)) AS k FROM t WHERE text IS NOT NULL) GROUP BY ALL),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.k = b.k)
SELECT doc_id, CAST(sum(least(x, y)) AS BIGINT) AS common, CAST(sum(x) AS BIGINT) AS "left", CAST(sum(y) AS BIGINT) AS "right", round(2 * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS f1 FROM j GROUP BY 1""")
def number_multiset_f1(spark, sf):
    numbers = lambda d: M.counts(d.where(F.col("text").isNotNull()).select("doc_id", F.explode(S.numbers(F.col("text"))).alias("k")), ["doc_id", "k"])
    return M.f1(numbers(words(spark, sf)), numbers(blocks(spark, sf)), ["doc_id"], "k").withColumn("f1", F.round("f1", 6))


@query(f"WITH {W}, {T}, {_CW}, {_CB}, {_J} SELECT doc_id, round(1 - sum(abs(a - b)) / sum(a + b), 6) AS similarity FROM j GROUP BY 1")
def char_profile_similarity(spark, sf):
    a, b = _both(spark, sf)
    return M.profile_similarity(a, b, ["doc_id"], "c").withColumn("similarity", F.round("similarity", 6))


_CLASSES = {"replacement": "\\x{FFFD}", "private": "\\x{E000}-\\x{F8FF}", "control": "\\x{00}-\\x{08}\\x{0E}-\\x{1F}\\x{7F}-\\x{84}\\x{86}-\\x{9F}", "soft_hyphen": "\\x{AD}", "combining": "\\x{300}-\\x{36F}", "zero_width": "\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}"}


@query(f"WITH {W} SELECT doc_id, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '[{v}]')) AS {k}" for k, v in _CLASSES.items()) + " FROM w GROUP BY 1")
def unicode_audit(spark, sf):
    """Words with characters of each doubtful class."""
    return words(spark, sf).groupBy("doc_id").agg(*[F.count_if(F.col("text").rlike(f"[{v}]")).alias(k) for k, v in _CLASSES.items()])


@query(f"""WITH {T}, h AS (SELECT doc_id, page, ord, block_id, CASE WHEN regexp_matches(text, '^\\s*[0-9]+[.][0-9]+') THEN 2 WHEN regexp_matches(text, '^\\s*[0-9]+[.]') THEN 3 ELSE 1 END AS level FROM t WHERE kind = 'heading' AND text IS NOT NULL)
SELECT h.block_id, h.level, arg_max(p.block_id, struct_pack(a := p.page, b := p.ord, c := p.block_id)) AS parent FROM h LEFT JOIN h AS p ON p.doc_id = h.doc_id AND p.level < h.level AND (p.page < h.page OR (p.page = h.page AND (p.ord < h.ord OR (p.ord = h.ord AND p.block_id < h.block_id)))) GROUP BY 1, 2""")
def section_parent(spark, sf):
    """The section tree: each heading under the nearest one before of higher rank."""
    h = blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull())
    level = F.when(F.col("text").rlike(r"^\s*[0-9]+[.][0-9]+"), 2).when(F.col("text").rlike(r"^\s*[0-9]+[.]"), 3).otherwise(1)
    return O.parents(h.withColumn("level", level), 3).select("block_id", "level", "parent")


@query(f"""WITH {T}, h AS (SELECT doc_id, page, max(block_id) AS mark FROM t WHERE kind = 'heading' GROUP BY 1, 2)
SELECT t.block_id AS key, arg_max(h.mark, h.page) AS mark FROM t LEFT JOIN h ON h.doc_id = t.doc_id AND h.page <= t.page WHERE t.kind = 'footnote' GROUP BY 1""")
def page_bookmark_asof(spark, sf):
    """Footnotes and the latest heading at or before their page."""
    b = blocks(spark, sf)
    return O.last_before(b.where(F.col("kind") == "footnote").select("doc_id", "page", F.col("block_id").alias("key")), b.where(F.col("kind") == "heading").select("doc_id", "page", F.col("block_id").alias("mark")))


@query(f"""WITH {T}, r AS (SELECT * FROM raw_records WHERE kind = 'toc' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1),
e AS (SELECT rec_id, lower(regexp_replace(json_extract_string(payload, '$.title[0].text'), '[^\\pL\\pN]', '', 'g')) AS k, TRY_CAST(json_extract_string(payload, '$.page') AS INT) AS page FROM r),
h AS (SELECT block_id, page, lower(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS k FROM t WHERE kind = 'heading' AND text IS NOT NULL)
SELECT e.rec_id, h.block_id FROM e JOIN h ON e.k = h.k AND h.page BETWEEN e.page - 100 AND e.page + 200 WHERE e.k <> ''""")
def contents_heading_join(spark, sf):
    """Root entries and headings of any document with the same letters within a range of pages, as the SQL has it; the
    headings that entries name are in ``contents_headings``."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "toc") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    e = r.select("rec_id", S.alnum_key(F.get_json_object("payload", "$.title[0].text")).alias("k"), F.get_json_object("payload", "$.page").try_cast("int").alias("p")).where(F.col("k") != "")
    h = blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull()).select("block_id", "page", S.alnum_key(F.col("text")).alias("k"))
    return e.join(h, "k").where(F.col("page").between(F.col("p") - 100, F.col("p") + 200)).select("rec_id", "block_id")


@query()
def contents_headings(spark, sf):
    """The heading that each contents entry names: a close title on its pages of its document, else the same title after
    the cursor."""
    b = blocks(spark, sf)
    joined = runs(spark, sf).groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("joined"))
    b = b.join(joined, "block_id", "left").withColumn("text", F.coalesce("text", "joined"))
    return contents.headings_named(table(spark, sf, "raw_records"), b)


@query("""WITH r AS (SELECT * FROM raw_records WHERE kind = 'bibl' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1),
f AS (SELECT rec_id, lower(json_extract_string(payload, '$.authors[0].surname')) AS s FROM r), n AS (SELECT DISTINCT name_id, lower(surname) AS s FROM bib_names WHERE surname <> '')
SELECT n.name_id, count(f.rec_id) AS refs, min(f.rec_id) AS first_ref FROM n LEFT JOIN f USING (s) GROUP BY 1""")
def citation_key_join(spark, sf):
    """Names as cited and the references whose first author has that surname."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "bibl") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    f = r.select("rec_id", F.lower(F.get_json_object("payload", "$.authors[0].surname")).alias("s")).where(F.col("s").isNotNull())
    by = f.groupBy("s").agg(F.count(F.lit(1)).alias("refs"), F.min("rec_id").alias("first_ref"))
    n = table(spark, sf, "bib_names").where(F.col("surname") != "").select("name_id", F.lower("surname").alias("s")).distinct()
    return n.join(by, "s", "left").groupBy("name_id").agg(F.sum(F.coalesce("refs", F.lit(0))).alias("refs"), F.min("first_ref").alias("first_ref"))


@query("SELECT d.doc_id, d.forked_from FROM documents d WHERE forked_from IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.forked_from AND e.text IS NOT NULL)")
def dangling_links_anti(spark, sf):
    """Links to documents that aren't there, or have no text."""
    d = table(spark, sf, "documents")
    there = d.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("forked_from"))
    return d.where(F.col("forked_from").isNotNull()).select("doc_id", "forked_from").join(there, "forked_from", "left_anti").select("doc_id", "forked_from")


@query(f"""WITH {T}, k AS (SELECT *, lower(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS key FROM t WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page, ord, block_id) AS n FROM k WHERE kind = 'heading' AND key <> '')
SELECT block_id, n = 1 AS kept FROM o""")
def running_heads_first_kept(spark, sf):
    """Headings that come again in a document: the first stays."""
    h = blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull()).withColumn("key", S.alnum_key(F.col("text"))).where(F.col("key") != "")
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("page", "ord", "block_id"))
    return h.select("block_id", (first == 1).alias("kept"))


@query(f"""WITH {T}, l AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id, page ORDER BY ord, block_id) = 'list_item' THEN 0 ELSE 1 END AS nw FROM t), g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page ORDER BY ord, block_id) AS isl FROM l WHERE TRUE)
SELECT doc_id, page, min(ord) AS first_ord, count(*) AS items FROM g WHERE kind = 'list_item' GROUP BY doc_id, page, isl""")
def list_islands(spark, sf):
    """Consecutive list items of a page as one list."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id")
    b = blocks(spark, sf).withColumn("n", F.when(F.lag("kind").over(w) == "list_item", 0).otherwise(1)).withColumn("g", F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return b.where(F.col("kind") == "list_item").groupBy("doc_id", "page", "g").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("items")).drop("g")


@query(f"""WITH {T}, o AS (SELECT *, lead(text) OVER w AS nx, lead(kind) OVER w AS nk FROM t WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord, block_id))
SELECT block_id, regexp_matches(rtrim(text, ' ' || chr(10)), '[.!?…:]["”’»)]*$') AS ended, coalesce(nk = 'paragraph' AND regexp_matches(nx, '^[a-z]') AND NOT regexp_matches(rtrim(text, ' ' || chr(10)), '[.!?…:]["”’»)]*$'), false) AS runs_on FROM o WHERE kind = 'paragraph'""")
def paragraph_continuation(spark, sf):
    """Paragraphs without an end that go on in the next block of the page."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id")
    o = blocks(spark, sf).where(F.col("text").isNotNull()).withColumn("nx", F.lead("text").over(w)).withColumn("nk", F.lead("kind").over(w))
    ended = F.regexp_replace("text", r"[ \n]+\z", "").rlike(r"[.!?…:][\"”’»)]*$")
    return o.where(F.col("kind") == "paragraph").select("block_id", ended.alias("ended"), F.coalesce((F.col("nk") == "paragraph") & F.col("nx").rlike("^[a-z]") & ~ended, F.lit(False)).alias("runs_on"))


_CHECK = "r AS (SELECT * FROM raw_records WHERE kind = 'export_check' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY received_at DESC, payload DESC) = 1)"


@query(f"""WITH {_CHECK}, d AS (SELECT json_extract_string(payload, '$.target') AS target, unnest(json_extract(payload, '$.dropped[*]')) AS x FROM r) SELECT target, coalesce(json_extract_string(x, '$.reason'), 'none') AS reason, count(*) AS n FROM d WHERE json_type(x) = 'OBJECT' GROUP BY ALL""")
def drop_reasons(spark, sf):
    """Why blocks were dropped, by target; only where the ledger is an array as it should be, as the SQL has it. All
    ledgers are in ``dropped_by_reason``."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "export_check") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    v = F.try_parse_json("payload")
    d = r.select(F.get_json_object("payload", "$.target").alias("target"), F.explode(F.try_variant_get(v, "$.dropped", "array<variant>")).alias("x"))
    o = d.where(F.schema_of_variant("x").startswith("OBJECT"))
    return o.groupBy("target", F.coalesce(F.try_variant_get("x", "$.reason", "string"), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def dropped_by_reason(spark, sf):
    """Why blocks were dropped, by target: all dropped nodes of ``p5_found``, lone ones and those in JSON text too."""
    return nested.reasons(nested.record_triples(table(spark, sf, "raw_records")))


@query(f"""WITH {_CHECK}, m AS (SELECT json_extract_string(payload, '$.target') AS target, CAST(json_extract_string(payload, '$.blocks') AS BIGINT) AS blocks, CASE json_type(payload, '$.dropped') WHEN 'ARRAY' THEN json_array_length(payload, '$.dropped') WHEN 'VARCHAR' THEN json_array_length(CAST(json_extract_string(payload, '$.dropped') AS JSON)) ELSE 0 END AS dropped, CASE json_type(payload, '$.missing') WHEN 'ARRAY' THEN json_array_length(payload, '$.missing') WHEN 'VARCHAR' THEN json_array_length(CAST(json_extract_string(payload, '$.missing') AS JSON)) ELSE 0 END AS missing FROM r),
s AS (SELECT *, CASE WHEN missing > 0 THEN 'error' WHEN dropped > 3 THEN 'warn' WHEN dropped > 0 THEN 'info' ELSE 'ok' END AS status FROM m)
SELECT target, status, count(*) AS n, CAST(sum(blocks) AS BIGINT) AS blocks, max(CASE status WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst FROM s GROUP BY ALL""")
def export_ledger(spark, sf):
    """Exports by status: error with missing blocks, else by how many were dropped."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "export_check") & F.try_parse_json("payload").isNotNull())
    r = r.groupBy("rec_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    size = lambda p: F.coalesce(F.json_array_length(F.get_json_object("payload", p)), F.lit(0))
    m = r.select(F.get_json_object("payload", "$.target").alias("target"), F.get_json_object("payload", "$.blocks").cast("bigint").alias("blocks"), size("$.dropped").alias("d"), size("$.missing").alias("x"))
    m = m.withColumn("status", F.when(F.col("x") > 0, "error").when(F.col("d") > 3, "warn").when(F.col("d") > 0, "info").otherwise("ok"))
    rank = F.when(F.col("status") == "error", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "info", 1).otherwise(0)
    return m.groupBy("target", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("blocks"), F.max(rank).alias("worst"))


_RULES = {
    "unended_paragraph": ("warn", "kind = 'paragraph' AND NOT regexp_matches(rtrim(text, ' ' || chr(10)), '[.!?…。！？।።][\"”’»)*†0-9]*$')"),
    "numeral_heading": ("info", "kind = 'heading' AND regexp_matches(text, '^[0-9. ]+$')"),
    "empty_text": ("error", "trim(text, ' ') = ''"),
    "double_space": ("info", "contains(text, '  ')"),
    "broken_line": ("info", "contains(text, chr(10))"),
}


@query(f"WITH {T} " + " UNION ALL ".join(f"SELECT '{k}' AS code, '{s}' AS severity, kind, count(*) AS n FROM t WHERE text IS NOT NULL AND ({c}) GROUP BY kind" for k, (s, c) in _RULES.items()))
def issue_union(spark, sf):
    """Structural rules over blocks in one pass: every issue with its severity, by kind."""
    t = F.col("text")
    rules = {
        "unended_paragraph": ("warn", (F.col("kind") == "paragraph") & ~F.regexp_replace(t, r"[ \n]+\z", "").rlike("[.!?…。！？।።][\"”’»)*†0-9]*$")),
        "numeral_heading": ("info", (F.col("kind") == "heading") & t.rlike("^[0-9. ]+$")),
        "empty_text": ("error", F.trim(t) == ""),
        "double_space": ("info", t.contains("  ")),
        "broken_line": ("info", t.contains("\n")),
    }
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for k, (s, c) in rules.items()]), lambda x: x.isNotNull())
    return blocks(spark, sf).where(t.isNotNull()).select("kind", F.explode(found).alias("i")).groupBy("i.code", "i.severity", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE greatest(CASE WHEN lang IS NULL THEN 2 ELSE 0 END, CASE WHEN title IS NULL THEN 3 ELSE 0 END, CASE WHEN len(warnings) > 0 THEN 1 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'info' ELSE 'ok' END AS status FROM doc_meta""")
def status_max(spark, sf):
    """The worst of several checks of a document."""
    checks = [(F.col("lang").isNull(), 2), (F.col("title").isNull(), 3), (F.size("warnings") > 0, 1)]
    worst = F.greatest(*[F.when(c, n).otherwise(0) for c, n in checks], F.lit(0))
    return table(spark, sf, "doc_meta").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("ok", "info", "warn", "error")]), worst + 1).alias("status"))


@query("""SELECT doc_type, count(*) AS n, count(*) FILTER (lower(coalesce(lang, 'en')) = 'en') AS default_lang, CAST(sum(pages) AS BIGINT) AS pages, max(made_at) = max(made_at) AS dated FROM doc_meta GROUP BY 1""")
def doc_type_summary(spark, sf):
    return table(spark, sf, "doc_meta").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower(F.coalesce("lang", F.lit("en"))) == "en").alias("default_lang"), F.sum("pages").alias("pages"), F.max("made_at").isNotNull().alias("dated"))


@query(f"""WITH {T}, k AS (SELECT doc_id, lower(text) AS x FROM t WHERE text IS NOT NULL AND page <= 30), s AS (SELECT doc_id, count(*) FILTER (regexp_matches(x, 'chapter|ch[.]|kapitel')) AS book, count(*) FILTER (regexp_matches(x, 'vol[.]|no[.]|inst[.]')) AS journal, count(*) FILTER (regexp_matches(x, 'table|fig[.]|abb[.]')) AS report FROM k GROUP BY 1)
SELECT doc_id, CASE WHEN journal > book AND journal > report THEN 'journal' WHEN book >= report AND book > 0 THEN 'book' WHEN report > 0 THEN 'report' ELSE 'generic' END AS guess FROM s""")
def doc_type_guess(spark, sf):
    """A document's type by the words of its first pages; the first rule that holds counts."""
    x = F.lower("text")
    s = blocks(spark, sf).where(F.col("text").isNotNull() & (F.col("page") <= 30)).groupBy("doc_id").agg(F.count_if(x.rlike("chapter|ch[.]|kapitel")).alias("b"), F.count_if(x.rlike("vol[.]|no[.]|inst[.]")).alias("j"), F.count_if(x.rlike("table|fig[.]|abb[.]")).alias("r"))
    return s.select("doc_id", F.when((F.col("j") > F.col("b")) & (F.col("j") > F.col("r")), "journal").when((F.col("b") >= F.col("r")) & (F.col("b") > 0), "book").when(F.col("r") > 0, "report").otherwise("generic").alias("guess"))


@query(f"""WITH {T}, p AS (SELECT doc_id, count(DISTINCT page) AS seen, min(page) AS lo, max(page) AS hi FROM t GROUP BY 1) SELECT m.doc_id, m.pages, coalesce(seen, 0) AS seen, m.pages - coalesce(seen, 0) AS unseen, coalesce(hi, 0) > m.pages AS beyond FROM (SELECT DISTINCT doc_id, pages FROM doc_meta) m LEFT JOIN p USING (doc_id)""")
def missing_pages(spark, sf):
    """Pages of each document that no block is on."""
    p = blocks(spark, sf).groupBy("doc_id").agg(F.countDistinct("page").alias("seen"), F.max("page").alias("hi"))
    m = table(spark, sf, "doc_meta").select("doc_id", "pages").distinct()
    return m.join(p, "doc_id", "left").select("doc_id", "pages", F.coalesce("seen", F.lit(0)).alias("seen"), (F.col("pages") - F.coalesce("seen", F.lit(0))).alias("unseen"), (F.coalesce("hi", F.lit(0)) > F.col("pages")).alias("beyond"))


@query(f"WITH {W} SELECT family, size, n FROM (SELECT family, size, count(*) AS n FROM w WHERE family IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY n DESC, family, size) <= 30")
def top_formats(spark, sf):
    """Top-k: the 30 most used formats."""
    by = words(spark, sf).where(F.col("family").isNotNull()).groupBy("family", "size").agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("n"), "family", "size").limit(30)


@query(f"""WITH {W}, v AS (SELECT doc_id, page, page + (length(doc_id) % 3) + CASE WHEN seq % 11 = 0 THEN 7 ELSE 4 END AS printed FROM w), o AS (SELECT doc_id, printed - page AS shift, count(*) AS votes FROM v GROUP BY ALL)
SELECT doc_id, CAST(shift AS INT) AS shift, votes FROM o WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, shift) = 1""")
def folio_offset_vote(spark, sf):
    """The most common difference of printed and physical page numbers, at least two votes; folios are made from keys."""
    w = words(spark, sf)
    printed = F.col("page") + F.length("doc_id") % 3 + F.when(F.col("seq") % 11 == 0, 7).otherwise(4)
    o = w.groupBy("doc_id", (printed - F.col("page")).cast("int").alias("shift")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= 2)
    return o.groupBy("doc_id").agg(F.max_by(F.struct("shift", "votes"), F.struct("votes", -F.col("shift"))).alias("m")).select("doc_id", "m.*")
