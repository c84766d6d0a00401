import json

from quire.operators import contents as C


def test_keys_and_scores():
    assert C.title_key("C O N T E N T S") == "contents" and C.title_key("Été – 2") == "été2"
    assert [C.title_score({w}, {g}, f) for w, g, f in (("mill", "mill", False), ("themillwheel", "themilwheel", True), ("themillwheel", "themilwheel", False), ("themillwheel", "themill", True), ("mill", "mi", True))] == [2, 1, 0, 1, 0]


def test_cursor_label_and_title_lines():
    found = C.starts([(1, 5, 10, "Introduction"), (2, 5, 11, "Chapter 2"), (3, 5, 12, "The mill"), (4, 5, 13, "of the north"), (9, 8, 14, "Introduction")])
    entries = [("a", "Introduction", None, 40), ("b", "The mill of the north", "Chapter 2", 5), ("c", "Introduction", None, 40), ("d", "Introduction", None, 40)]
    assert C.matched(entries, C.Titles(found)) == [("a", 10, "title"), ("b", 11, "page"), ("c", 14, "title")]


def test_own_document_near_page_and_misspelt(spark):
    toc = {"title": [{"text": "The quiet "}, {"text": "river gauge"}], "page": 10, "children": {"title": [{"text": "Introduction"}], "page": 30}}
    r = spark.createDataFrame([(1, "toc", "d", json.dumps(toc), None), (2, "toc", "e", '{"title": [{"text": "Introduction"}]}', None)], "rec_id bigint, kind string, doc_id string, payload string, received_at timestamp")
    blocks = [(1, "d", 2, 1, "heading", "The quiet river gauge"), (2, "d", 12, 1, "heading", "The quiet rivr gauge"), (3, "d", 20, 1, "heading", "Introduction"), (4, "f", 10, 1, "heading", "The quiet river gauge"), (5, "d", 31, 1, "paragraph", "Introduction")]
    b = spark.createDataFrame(blocks, "block_id bigint, doc_id string, page int, ord bigint, kind string, text string")
    assert {tuple(x) for x in C.headings_named(r, b).collect()} == {(1, "$", 2, "page"), (1, "$.children.0", 3, "title")}
