"""Operators on pages and ledgers on small fixtures."""

import json

from pyspark.sql import functions as F

from quire.operators import ledger, nested, pages, spatial


def test_missing_reasons(spark):
    record = {"dropped": [{"page": 1, "text": "Running Head 7", "reason": "header"}, {"page": 1, "text": "A long query text", "reason": "query"}, {"page": 2, "text": "Slug", "reason": "furniture"}], "missing": [{"page": 1, "text": "running head 7"}, {"page": 1, "text": "query text"}, {"page": 1, "text": "Slug"}, {"page": 2, "text": "x"}, {"text": None}]}
    t = spark.createDataFrame([(r, "export_check", json.dumps(record), None) for r in (1, None)], "rec_id bigint, kind string, payload string, received_at timestamp")
    got = {(r.rec_id, r.node_path): (r.how, r.reason) for r in ledger.missing_reasons(nested.record_triples(t)).collect()}
    for k in (1, None):
        assert [got[k, f"$.missing.{i}"] for i in range(5)] == [("exact", "header"), ("contained", "query"), (None, None), (None, None), (None, None)]
    assert ledger.missing_reasons(nested.record_triples(t.limit(0))).count() == 0


def test_anchors_over_many_pages(spark):
    blocks = spark.createDataFrame([("d", 1, 10, 0.0, 0.0, 50.0, 20.0), ("d", 1, 11, 0.0, 30.0, 50.0, 40.0), ("d", 3, 30, 0.0, 0.0, 50.0, 9.0)], "doc_id string, page int, block_key int, x0 double, y0 double, x1 double, y1 double")
    new = spark.createDataFrame([(1, "d", 1, 0.0, 25.0, 9.0, 29.0), (2, "d", 1, 60.0, 90.0, 70.0, 99.0), (3, "d", 2, 0.0, 1.0, 9.0, 2.0), (4, "d", 3, 0.0, 10.0, 9.0, 12.0), (5, "d", 9, 60.0, 1.0, 70.0, 2.0), (6, "e", 1, 0.0, 1.0, 9.0, 2.0)], "new_key bigint, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.new_key: r.block_key for r in spatial.anchor_block(new, blocks).collect()} == {1: 10, 2: None, 3: 11, 4: 30, 5: 30, 6: None}


def test_roles_hosts_and_sentences(spark):
    d = spark.createDataFrame([("Tip: go", "https://www.a.example/x", "Dr. A. B. Rey came. He left."), ("Plan", "http://ba.example", "no end"), (None, None, None)], "t string, u string, s string")
    got = d.select(pages.box_role(F.col("t")).alias("r"), pages.allowed_host(F.col("u"), ["a.example"]).alias("a"), pages.first_sentence(F.col("s")).alias("f")).collect()
    assert [(r.r, r.a, r.f) for r in got] == [("tip", True, "Dr. A. B. Rey came."), ("box", False, "no end"), ("box", None, None)]


def test_ids_run_over_pages(spark):
    b = spark.createDataFrame([(1, "d", 2, 1, "heading"), (2, "d", 1, 5, "heading"), (3, "d", 1, 1, "paragraph"), (4, "d", 1, 2, "heading"), (5, "d", 3, 1, "footnote")], "block_id bigint, doc_id string, page int, ord bigint, kind string")
    assert {r.block_id: r.id for r in pages.numbered_in_order(b, ["heading", "paragraph"]).collect()} == {4: "h-1", 2: "h-2", 1: "h-3", 3: "p-1"}


def test_marker_beside_text(spark):
    w = spark.createDataFrame([(1, "d", 1, "•", 10.0, 0.0, 12.0, 10.0, 10.0), (2, "d", 1, "far", 90.0, 0.0, 99.0, 10.0, 10.0), (3, "d", 1, "near", 20.0, 2.0, 30.0, 9.0, 10.0), (4, "d", 1, "below", 20.0, 20.0, 30.0, 30.0, 10.0)], "word_id bigint, doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [tuple(r) for r in pages.beside(w.where("text = '•'"), w).collect()] == [(1, 3)]
