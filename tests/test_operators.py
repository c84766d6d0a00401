from pyspark.sql import functions as F

from quire.functions import boxes as B
from quire.functions import scalars as S
from quire.operators import matter as M
from quire.operators import multisets, order, spatial, structure
from quire.sources import readers, sinks

WORD = "word_id bigint, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, size double, upright boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v)])
    assert one(spark, B.share(box(0, 0, 10, 10), box(5, 0, 20, 10))) == 0.5
    assert one(spark, B.share(box(5, 5, 5, 5), box(0, 0, 10, 10))) == 1.0
    assert one(spark, B.distance(box(0, 0, 1, 1), box(4, 5, 6, 7))) == 7.0
    assert one(spark, B.contains(box(0, 0, 10, 10), box(-2, 0, 10, 10), 3.0))
    assert one(spark, B.clip(box(0, 0, 1, 1), box(2, 2, 3, 3))) is None


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.expand_ligatures(lit("oﬃ­ce"))) == "office"
    assert [one(spark, S.marker_kind(lit(x))) for x in ("(a)", "iv.", "3)", "•", "i.")] == ["(alpha)", "roman", "decimal", "bullet", "roman"]
    assert [one(spark, S.roman_value(lit(x))) for x in ("xiv", "MCMXC", "iiii", "")] == [14, 1990, None, None]
    assert one(spark, S.isbn_valid(lit("0-306-40615-2"))) and not one(spark, S.isbn_valid(lit("0-306-40615-3")))
    assert one(spark, S.hex_colour(F.array(lit(0.0), lit(1.0), lit(1.0), lit(0.0)))) == "#ff0000"
    assert one(spark, S.expand_numbers(lit("1, 3–5, x, 9-7"))) == [1, 3, 4, 5, 9, 7]
    assert one(spark, S.callout_key(lit("Figure 2.8A"))) == one(spark, S.callout_key(lit("Fig. 2.8a")))
    assert one(spark, S.urls(lit("see (https://a.example/b?c=1).")))[0] == "https://a.example/b?c=1"
    assert one(spark, S.safe_name(lit("../ä b?"))) == "ä_b" and one(spark, S.safe_name(lit(None).cast("string"))) == "document"
    assert one(spark, S.despaced(lit("C O N T E N T S"))) == "CONTENTS"
    assert one(spark, S.citation_keys(lit("World Mill Office"), lit("2020"))) == ["world|2020", "world mill office|2020", "worldmilloffice|2020", "wmo|2020"]


def test_words_to_blocks_with_ties_and_orphans(spark):
    w = spark.createDataFrame([(1, "d", 1, 0.0, 0.0, 10.0, 10.0, 10.0, True), (2, "d", 1, 100.0, 0.0, 110.0, 10.0, 10.0, True), (3, None, None, 0.0, 0.0, 1.0, 1.0, 10.0, True)], WORD)
    b = spark.createDataFrame([("d", 1, 7, 0.0, 0.0, 50.0, 60.0), ("d", 1, 5, 0.0, 0.0, 20.0, 20.0), ("d", 2, 9, 100.0, 0.0, 110.0, 10.0)], "doc_id string, page int, block_key bigint, x0 double, y0 double, x1 double, y1 double")
    assert {(r.word_id, r.block_key) for r in spatial.best_block(w, b).collect()} == {(1, 5), (2, None), (3, None)}
    assert spatial.nearest_block(w.where("word_id = 2"), b).count() == 0
    assert {r.thing_key for r in spatial.unheld(w.withColumnRenamed("word_id", "thing_key"), b).collect()} == {2, 3}


def test_lines_and_order(spark):
    w = spark.createDataFrame([(1, "d", 1, 0.0, 0.0, 10.0, 10.0, 10.0, True), (2, "d", 1, 12.0, 1.0, 20.0, 11.0, 10.0, True), (3, "d", 1, 0.0, 20.0, 9.0, 30.0, 10.0, True), (4, "d", 1, 21.0, -2.0, 24.0, 4.0, 6.0, True), (5, "d", 1, 0.0, 0.0, 2.0, 2.0, 9.0, False)], WORD)
    assert {r.word_id: r.line for r in structure.visual_lines(w).collect()} == {1: 0, 2: 0, 4: 0, 3: 1, 5: 2}
    boxes = [("title", 0, 0, 100, 10)] + [(f"L{i}", 0, 20 + 20 * i, 45, 35 + 20 * i) for i in range(3)] + [(f"R{i}", 55, 20 + 20 * i, 100, 35 + 20 * i) for i in range(3)]
    b = spark.createDataFrame([("d", 1, i, *map(float, x[1:])) for i, x in enumerate(boxes)], "doc_id string, page int, block_key bigint, x0 double, y0 double, x1 double, y1 double")
    got = [boxes[r.block_key][0] for r in structure.xy_cut(b).orderBy("position").collect()]
    assert got[0] == "title" and set(got) == {x[0] for x in boxes}


def test_list_nesting(spark):
    marks = ["1.", "2.", "•", "•", "3.", "•", "4."]
    items = spark.createDataFrame([("d", 1, i, i, m, 0.0) for i, m in enumerate(marks)], "doc_id string, page int, ord bigint, block_id bigint, marker string, x0 double")
    assert [r.depth for r in structure.list_nesting(items).orderBy("block_id").collect()] == [1, 1, 2, 2, 1, 2, 1]


def test_section_parents(spark):
    h = spark.createDataFrame([("d", 1, 1, 10, 1), ("d", 1, 2, 11, 2), ("d", 5, 1, 12, 3), ("d", 6, 1, 13, 2), ("e", 1, 1, 14, 3)], "doc_id string, page int, ord bigint, block_id bigint, level int")
    assert {r.block_id: r.parent for r in order.parents(h, 3).collect()} == {10: None, 11: 10, 12: 11, 13: 10, 14: None}


def test_multisets(spark):
    a = spark.createDataFrame([("g", "a", 3), ("g", "b", 1)], "g string, c string, n bigint")
    b = spark.createDataFrame([("g", "a", 1), ("g", "B", 1)], "g string, c string, n bigint")
    assert {(r.c, r.n) for r in multisets.difference(a, b, ["g", "c"]).collect()} == {("a", 2), ("b", 1)}
    assert multisets.f1(a, b, ["g"], "c").first()["f1"] == 2 / 6
    assert {(r.c, r.n) for r in multisets.case_netted(multisets.difference(a, b, ["g", "c"]), multisets.difference(b, a, ["g", "c"]), ["g"]).collect()} == {("a", 2)}
    assert {(r.c, r.n) for r in multisets.added(a, b, ["g", "c"]).collect()} == {("a", 4), ("b", 1), ("B", 1)}


def test_ink(spark):
    cells = [(x, 0) for x in range(6)] + [(x, y) for x in range(20, 24) for y in range(5, 9)]
    c = spark.createDataFrame([("d", 1, x, y) for x, y in cells], "doc_id string, page int, x int, y int")
    assert [r["shape"] for r in structure.ink_regions(c).orderBy("region").collect()] == ["rule", "filled"]


def test_readers_of_matter():
    r = M.parse_reference("Smith, J. (2020a). The mill. Journal of Kilns, 12(3), 45–60. 10.1234/ab.c")
    assert (r["authors"], r["year"], r["title"], r["volume"], r["issue"], r["pages"], r["doi"]) == ("Smith, J", "2020a", "The mill", "12", "3", "45–60", "10.1234/ab.c")
    r = M.parse_reference("3. Smith J, Glanz K. The mill. J Kilns. 2019;12(3):45-60.")
    assert (r["authors"], r["title"], r["source"], r["year"], r["volume"], r["pages"]) == ("Smith J, Glanz K", "The mill", "J Kilns", "2019", "12", "45-60")
    assert M.parse_reference("A plain sentence.") is None and M.parse_reference(None) is None
    assert M.parse_contents_line("2.1 The mill ..... xii") == {"label": "2.1", "title": "The mill", "folio": "xii", "level": "2"}
    assert M.parse_index_line("Kiln, brick, 3, 5–7. See also Oven")["see_also"] == "Oven"
    assert M.parse_glossary_line("Quoin: a wedge") == {"term": "Quoin", "definition": "a wedge"}
    assert M.parse_imprint("no imprint") is None
    assert M.line_diff("a\nthe line that moved away\nb", "b\nthe line that moved away\na")["moved"] in (0, 1)
    assert M.similarity("", "") == 1 and M.similarity("abcd", "abce") == 0.75


def test_sources_and_outputs(spark, tmp_path):
    import pytest

    assert readers.parse_pages("5,1-3,2") == [1, 2, 3, 5]
    for bad in ("", "3-1", "0", "a", "1-99999"):
        with pytest.raises(ValueError):
            readers.parse_pages(bad)
    b = spark.createDataFrame([("d", 1, 1, 1, "heading", 'a<b & "c"\x01'), ("d", 1, 2, 2, "list_item", None)], "doc_id string, page int, ord bigint, block_id bigint, kind string, text string")
    assert [r.xml for r in sinks.block_xml(b, "publishing").orderBy("ord").collect()] == ["<title>a&lt;b &amp; &quot;c&quot;</title>", "<list-item><p></p></list-item>"]
    back = sinks.read_canonical(sinks.canonical_json(b, b.columns), b.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, b.collect()))
    assert sinks.epub_bytes("k", "t", [("a", "<p>x</p>")]) == sinks.epub_bytes("k", "t", [("a", "<p>x</p>")])
    sinks.write_lines(sinks.block_xml(b), "xml", str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    assert '"additionalProperties": false' in sinks.json_schema(b.schema, "block")
    (tmp_path / "A.pdf").write_bytes(b"1"), (tmp_path / "a.xml").write_bytes(b"2")
    files = readers.read_files(spark, str(tmp_path), "*.pdf").select("path"), readers.read_files(spark, str(tmp_path), "*.xml").select("path")
    assert [r.stem for r in readers.paired(*files).collect()] == ["a"]
    (tmp_path / "p.json").write_text('{"size": 3}')
    assert readers.load_profile(str(tmp_path / "p.json"), {"size": int}) == {"size": 3}
    with pytest.raises(ValueError):
        readers.load_profile(str(tmp_path / "p.json"), {"other": int})
    n = []
    build = lambda: (n.append(1), spark.range(3))[1]
    key = {"test": str(tmp_path)}
    assert readers.cached(spark, key, build).count() == 3 and readers.cached(spark, key, build).count() == 3 and len(n) == 1
