"""Queries with scalar functions, over blocks, records and the wider tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.plans.layout import T, W, blocks, words
from quire.plans.registry import query
from quire.sources.tables import table

_MARK = r"'^\s*([•‣▪–◦■*†‡-]|\(?[0-9]{1,3}[.)]|\(?[ivxlc]{1,6}[.)]|\(?[A-Za-z][.)])\s+'"


@query(f"""WITH {T}, m AS (SELECT kind, regexp_extract(text, {_MARK}, 1) AS marker FROM t WHERE text IS NOT NULL), k AS (SELECT kind, marker, regexp_replace(marker, '[().]', '', 'g') AS b FROM m),
c AS (SELECT kind, marker, CASE WHEN marker = '' THEN NULL WHEN regexp_matches(b, '^[0-9]+$') THEN 'decimal' WHEN regexp_matches(b, '^[ivxlc][ivxlc]+$') OR regexp_matches(b, '^[ivx]$') THEN 'roman' WHEN regexp_matches(b, '^[A-Za-z]$') THEN 'alpha' ELSE 'bullet' END AS marker_kind FROM k)
SELECT kind, marker, CASE WHEN starts_with(marker, '(') THEN '(' || marker_kind || ')' ELSE marker_kind END AS marker_kind, count(*) AS n FROM c GROUP BY ALL""")
def marker_kind(spark, sf):
    m = blocks(spark, sf).where(F.col("text").isNotNull()).select("kind", S.marker(F.col("text")).alias("marker"))
    return m.withColumn("marker_kind", S.marker_kind(F.col("marker"))).groupBy("kind", "marker", "marker_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT i AS n, repeat('m', (i // 1000)::INT) || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][(i // 100) % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][(i // 10) % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][i % 10 + 1] AS roman FROM range(1, 4000) r(i)) SELECT n, roman, CAST(n AS INT) AS back FROM h""")
def roman_roundtrip(spark, sf):
    r = spark.range(1, 4000).select(F.col("id").alias("n"), S.to_roman(F.col("id")).alias("roman"))
    return r.withColumn("back", S.roman_value(F.col("roman")))


@query("""WITH d AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part), c AS (SELECT p_partkey, b, (10 - list_sum([CAST(substr(b, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10) % 10 AS k FROM d)
SELECT p_partkey, b || k AS isbn, true AS valid, false AS shifted FROM c""")
def isbn_checksum(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")).alias("b"))
    p = p.withColumn("k", S.isbn_check_digit(F.col("b")))
    wrong = F.concat("b", ((F.col("k").cast("int") + 1) % 10).cast("string"))
    return p.select("p_partkey", F.concat("b", "k").alias("isbn"), S.isbn_valid(F.concat("b", "k")).alias("valid"), S.isbn_valid(wrong).alias("shifted"))


@query(f"""WITH {T} SELECT block_id, lower(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters, lower(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS alnum, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, upper(text) = text AND lower(text) <> text AS caps FROM t WHERE text IS NOT NULL AND kind = 'heading'""")
def normalise_keys(spark, sf):
    t = F.col("text")
    return blocks(spark, sf).where(t.isNotNull() & (F.col("kind") == "heading")).select("block_id", S.letters_key(t).alias("letters"), S.alnum_key(t).alias("alnum"), S.mask_digits(t).alias("masked"), S.caps(t).alias("caps"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS text_key FROM documents WHERE text IS NOT NULL")
def hash_identity(spark, sf):
    t = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))).alias("text_key"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(title || '; ' || coalesce(doc_type, 'none') || ', ' || coalesce(engine, '') || ' ;', ';')) AS p FROM doc_meta WHERE title IS NOT NULL), q AS (SELECT doc_id, unnest(string_split(p, ',')) AS k FROM l), r AS (SELECT doc_id, trim(regexp_replace(k, '[. ]+$', ''), ' ') AS k FROM q)
SELECT doc_id, count(DISTINCT k) AS n, max(k) AS last FROM r WHERE k <> '' GROUP BY 1""")
def keyword_split(spark, sf):
    m = table(spark, sf, "doc_meta").where(F.col("title").isNotNull())
    line = F.concat("title", F.lit("; "), F.coalesce("doc_type", F.lit("none")), F.lit(", "), F.coalesce("engine", F.lit("")), F.lit(" ;"))
    return m.select("doc_id", F.explode(S.keywords(line)).alias("k")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))


@query("""WITH s AS (SELECT s_suppkey, '[' || (s_suppkey % 40 + 1) || ', ' || (s_suppkey % 17 + 3) || '–' || (s_suppkey % 17 + 3 + s_suppkey % 60) || ', x]' AS spec, s_suppkey % 40 + 1 AS a, s_suppkey % 17 + 3 AS lo, s_suppkey % 17 + 3 + s_suppkey % 60 AS hi FROM supplier)
SELECT s_suppkey, CAST(unnest([a] || CASE WHEN hi - lo < 50 THEN range(lo, hi + 1) ELSE [lo, hi] END) AS INT) AS ref FROM s""")
def numeric_citation_expand(spark, sf):
    k = F.col("s_suppkey")
    spec = F.concat(F.lit("["), k % 40 + 1, F.lit(", "), k % 17 + 3, F.lit("–"), k % 17 + 3 + k % 60, F.lit(", x]"))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(S.expand_numbers(F.regexp_replace(spec, r"[\[\]]", ""))).alias("ref"))


@query(f"""WITH {T} SELECT block_id, regexp_extract(text, '((?:https?://|www[.])[^\\s<>]+)', 1) <> '' AS has_url, regexp_replace(regexp_extract(text, '((?:https?://|www[.])[^\\s<>]+)', 1), '[.,;:!?)\\]]+$', '') AS first_url FROM t WHERE text LIKE '%://%' OR text LIKE '%www.%'""")
def url_extract(spark, sf):
    t = blocks(spark, sf).where(F.col("text").contains("://") | F.col("text").contains("www."))
    u = S.urls(F.col("text"))
    return t.select("block_id", (F.size(u) > 0).alias("has_url"), F.coalesce(F.try_element_at(u, F.lit(1)), F.lit("")).alias("first_url"))


@query(f"""WITH {W} SELECT DISTINCT font, regexp_replace(regexp_replace(regexp_replace(regexp_replace(font, '^[A-Z]{{6}}[+]', ''), '[-,].*$', ''), '(MT|PS)$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') AS family_of, regexp_matches(lower(font), 'bold|black|heavy|semibold') AS is_bold, regexp_matches(lower(font), 'italic|oblique') AS is_italic, regexp_matches(lower(font), 'mono|courier|consol|typewriter') AS is_mono FROM w WHERE font IS NOT NULL""")
def font_names(spark, sf):
    f = words(spark, sf).where(F.col("font").isNotNull()).select("font").distinct()
    s = S.font_style(F.col("font"))
    return f.select("font", S.font_family(F.col("font")).alias("family_of"), s["bold"].alias("is_bold"), s["italic"].alias("is_italic"), s["mono"].alias("is_mono"))


@query(f"""WITH {W} SELECT color, count(*) AS n, abs(CAST('0x' || substr(color, 2, 2) AS INT) - 0x1f) + abs(CAST('0x' || substr(color, 4, 2) AS INT) - 0x3d) + abs(CAST('0x' || substr(color, 6, 2) AS INT) - 0x7a) AS distance FROM w WHERE color IS NOT NULL GROUP BY 1""".replace("0x1f)", "31)").replace("0x3d)", "61)").replace("0x7a)", "122)"))
def colour_distances(spark, sf):
    c = words(spark, sf).where(F.col("color").isNotNull()).groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("distance", S.colour_distance(F.col("color"), F.lit("#1f3d7a")))


@query("""SELECT p_partkey, '#' || h || h || h AS grey FROM (SELECT p_partkey, lpad(lower(printf('%x', CAST(round_even(p_size / 50.0 * 255, 0) AS INT))), 2, '0') AS h FROM part)""")
def hex_colours(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.hex_colour(F.array(F.col("p_size") / F.lit(50.0))).alias("grey"))


@query(f"""WITH {T}, k AS (SELECT block_id, regexp_extract(text, '^\\s*((?:Fig|Table|Abb)[.]?\\s*[0-9]+(?:[.][0-9]+)*)', 1) AS label FROM t WHERE kind = 'caption' AND text IS NOT NULL)
SELECT block_id, label, lower(substr(regexp_extract(label, '^(\\pL+)', 1), 1, 3)) || '|' || regexp_extract(label, '([0-9]+(?:[.][0-9]+)*)', 1) || '|' AS key FROM k WHERE label <> ''""")
def callout_keys(spark, sf):
    c = blocks(spark, sf).where((F.col("kind") == "caption") & F.col("text").isNotNull())
    c = c.select("block_id", F.regexp_extract("text", r"^\s*((?:Fig|Table|Abb)[.]?\s*[0-9]+(?:[.][0-9]+)*)", 1).alias("label")).where(F.col("label") != "")
    return c.withColumn("key", S.callout_key(F.col("label")))


@query(f"""WITH {T} SELECT block_id, replace(replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(173), ''), '', '') AS text FROM t WHERE text IS NOT NULL AND regexp_matches(text, '[ﬀﬁﬂﬃﬄ\\x{{AD}}]')""")
def ligatures_expanded(spark, sf):
    return blocks(spark, sf).where(F.col("text").rlike("[ﬀﬁﬂﬃﬄ­]")).select("block_id", S.expand_ligatures(F.col("text")).alias("text"))


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.2f', o_totalprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS short FROM orders""")
def two_decimals(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.two_decimals(F.col("o_totalprice")).alias("short"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN 'document' ELSE substr(t, 1, 80) END AS file FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(title, ''), '[^\\pL\\pN\\pM._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS t FROM doc_meta)""")
def safe_names(spark, sf):
    return table(spark, sf, "doc_meta").select("doc_id", S.safe_name(F.col("title")).alias("file"))


@query(f"""WITH {T} SELECT block_id, CASE WHEN regexp_matches(text, p) THEN regexp_extract(text, p, 1) ELSE '' END AS label, CASE WHEN regexp_matches(text, p) THEN regexp_extract(text, p, 2) ELSE text END AS title FROM (SELECT *, '^\\s*((?:(?:Chapter|Ch\\.|Part|Appendix|Annexe|Anhang|Anexo|Fig\\.|Figure|Table|Abb\\.)\\s*)?(?:[0-9]+(?:\\.[0-9]+)*|[A-Z])[.:)]?)\\s+(\\S.*)$' AS p FROM t WHERE kind = 'heading' AND text IS NOT NULL AND text NOT LIKE '%' || chr(10) || '%')""")
def heading_labels(spark, sf):
    h = blocks(spark, sf).where((F.col("kind") == "heading") & F.col("text").isNotNull() & ~F.col("text").contains("\n"))
    s = S.split_label(F.col("text"))
    return h.select("block_id", s["label"].alias("label"), s["title"].alias("title"))


@query(f"""WITH {T}, n AS (SELECT kind, unnest(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*)', 1)) AS number FROM t WHERE text IS NOT NULL) SELECT kind, number, count(*) AS n FROM n GROUP BY ALL""")
def number_counts(spark, sf):
    return blocks(spark, sf).where(F.col("text").isNotNull()).select("kind", F.explode(S.numbers(F.col("text"))).alias("number")).groupBy("kind", "number").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T} SELECT block_id, trim(regexp_replace(regexp_replace(translate(text, '‘’“”–—−' || chr(160), '''''""--- '), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS text FROM t WHERE text IS NOT NULL""")
def compare_normaliser(spark, sf):
    return blocks(spark, sf).where(F.col("text").isNotNull()).select("block_id", S.normal_compare(F.col("text")).alias("text"))


@query("SELECT rec_id, json_extract_string(TRY_CAST(payload AS JSON), '$.folio') AS folio, CASE WHEN regexp_matches(json_extract_string(TRY_CAST(payload AS JSON), '$.folio'), '^[0-9]{1,6}$') THEN TRY_CAST(json_extract_string(TRY_CAST(payload AS JSON), '$.folio') AS INT) WHEN json_extract_string(TRY_CAST(payload AS JSON), '$.folio') = 'iv' THEN 4 WHEN json_extract_string(TRY_CAST(payload AS JSON), '$.folio') = 'xii' THEN 12 END AS value FROM raw_records WHERE kind = 'toc' AND TRY_CAST(payload AS JSON) IS NOT NULL AND json_valid(payload)")
def folio_values(spark, sf):
    """Printed page numbers of the root entries that can be read, as numbers."""
    r = table(spark, sf, "raw_records").where((F.col("kind") == "toc") & F.try_parse_json("payload").isNotNull())
    return r.select("rec_id", F.get_json_object("payload", "$.folio").alias("folio")).withColumn("value", S.folio_value(F.col("folio")))
