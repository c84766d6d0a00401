import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.operators import nested as N

SCHEMA = "rec_id bigint, kind string, doc_id string, payload string, received_at timestamp, node_kind string, ordinal int"


def rows(spark, data):
    import datetime as dt

    d = [(r, k, "d", p, None if t is None else dt.datetime(2030, 1, t), "clash", 9) for r, k, p, t in data]
    return {(x.rec_id, x.node_kind, x.node_path, x.parent_path) for x in N.nodes(spark.createDataFrame(d, SCHEMA)).collect()}


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=20)


def tree(value, path, parent, ordinal, kind):
    """Brute force over the tree that the usual decoder builds."""
    yield kind, path, parent, ordinal, None, None
    if not isinstance(value, dict):
        yield kind, path, parent, ordinal, "value", value
        return
    for name, x in value.items():
        if name in N.REPEATED.get(kind, {}):
            if isinstance(x, str) and x.lstrip()[:1] == "[":
                try:
                    inner = json.loads(x)
                    x = inner if isinstance(inner, list) else x
                except ValueError:
                    pass
            for i, e in enumerate(x if isinstance(x, list) else [x]):
                if e is not None:
                    yield from tree(e, f"{path}.{name}.{i}", path, i, N.REPEATED[kind][name])
        elif x is not None:
            yield kind, path, parent, ordinal, name, x


names = st.sampled_from(["children", "contributors", "title", "x"])
entries = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=3) | st.just('["a", null]') | st.just("[1"), lambda v: st.lists(v, max_size=3) | st.dictionaries(names, v, max_size=4), max_leaves=20)


@given(st.dictionaries(names, entries, max_size=4))
def test_triples_are_those_of_the_tree(value):
    want = sorted(repr((*t[:5], t[5])) for t in tree(value, "$", "", 0, "toc_entry"))
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        got = []
        for *node, field, v in N.triples("toc", text):
            try:
                v = v if v is None or not isinstance(dict(map(lambda t: (tuple(t[:5]), t[5]), tree(value, "$", "", 0, "toc_entry")))[*node, field], (dict, list, bool, int)) else json.loads(v)
            except KeyError:
                pass
            got.append(repr((*node, field, v)))
        assert sorted(got) == want


def readable(text):
    try:
        return isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), dict)
    except (ValueError, ZeroDivisionError):
        return False


@given(values)
def test_what_json_reads_is_read(value):
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        assert (N.read("toc", text) is not None) == isinstance(value, dict) == (N.read("else", text) == [])


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a":1,}', "1 2", '"\n"', "{]", "nul", "[1}", '{"a"}', '{"a": NaN}', '{"a": 01}', '{"a": 1}x', "{\xa0}", '{"a": "\x01"}', "{}", ' {"a": [1, {"b": "\\ud800"}]} '])
def test_broken_text_is_unreadable(text):
    assert (N.read("toc", text) is not None) == readable(text)


def test_fields_given_twice():
    assert list(N.triples("toc", '{"label": "a", "children": [{"label": "b"}, {}], "label": "c", "children": {"label": "d"}}')) == [
        ("toc_entry", "$", "", 0, None, None), ("toc_entry", "$", "", 0, "label", "c"), ("toc_entry", "$.children.0", "$", 0, None, None), ("toc_entry", "$.children.0", "$", 0, "label", "d")
    ]


def test_very_deep_nesting():
    text = '{"children":[' * 30_000 + "{}" + "]}" * 30_000
    assert sum(1 for _ in N.triples("toc", text, fields=False)) == 30_001


def test_shapes(spark):
    toc = {"title": [{"text": "x"}], "contributors": "A", "children": [None, {}, {"children": {"contributors": json.dumps(["B", None, "C"])}}]}
    got = rows(spark, [(1, "toc", json.dumps(toc), 1)])
    assert got == {
        (1, "toc_entry", "$", ""), (1, "contributor", "$.contributors.0", "$"), (1, "toc_entry", "$.children.1", "$"), (1, "toc_entry", "$.children.2", "$"),
        (1, "toc_entry", "$.children.2.children.0", "$.children.2"), (1, "contributor", "$.children.2.children.0.contributors.0", "$.children.2.children.0"), (1, "contributor", "$.children.2.children.0.contributors.2", "$.children.2.children.0"),
    }


def test_deliveries_nulls_and_unknown_kinds(spark):
    data = [(1, "bibl", '{"authors": [{}]}', 1), (1, "bibl", '{"authors": []}', 2), (1, "bibl", '{"authors": [', 3), (2, "bibl", None, 1), (2, "bibl", "", 2), (3, "else", "{}", 1), (None, "toc", "{}", None), (4, "toc", "[]", 1), (5, None, "{}", 1), (6, "toc", "{}", 1), (6, "toc", "{}", 1)]
    assert rows(spark, data) == {(1, "bibl", "$", ""), (None, "toc_entry", "$", ""), (6, "toc_entry", "$", "")}


def test_empty_table(spark):
    assert N.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivot(spark):
    t = spark.createDataFrame([(1, "export_check", "d", '{"dropped": [{"page": 3, "text": "a"}, {"page": null}]}', None, "", 0)], SCHEMA)
    got = N.flat_table(N.record_triples(t), "dropped", ["page", "text"]).orderBy("ordinal").collect()
    assert [(r.node_path, r.page, r.text) for r in got] == [("$.dropped.0", "3", "a"), ("$.dropped.1", None, None)]


def test_reasons_of_every_shape(spark):
    one = {"reason": "watermark"}
    ledgers = [[one, {"reason": None}, None, "x"], one, json.dumps([one, one]), None, []]
    t = spark.createDataFrame([(i, "export_check", "d", json.dumps({"target": "xml", "dropped": d}), None, "", 0) for i, d in enumerate(ledgers)] + [(9, "export_check", "d", json.dumps({"dropped": one}), None, "", 0)], SCHEMA)
    assert {tuple(x) for x in N.reasons(N.record_triples(t)).collect()} == {("xml", "watermark", 4), ("xml", "none", 2), (None, "watermark", 1)}


def test_all_tables(spark):
    payloads = {
        "toc": {"title": [{"text": "x"}], "level": 1, "contributors": ["A", "B"], "children": [{"label": "1", "contributors": "C"}]},
        "bibl": {"title_a": "T", "year": 1999, "authors": [{"surname": "S", "given": ["G", "H"], "org": None}, "Lone"], "editors": {"surname": "E", "given": "I"}},
        "export_check": {"target": "xml", "blocks": 3, "missing_chars": {"a": 1}, "dropped": [{"page": 1, "reason": "r"}], "moved": {"page": 2}, "missing": [{"page": 3, "absent_words": ["u", "v"]}, {}]},
    }
    t = spark.createDataFrame([(i, k, "d", json.dumps(p), None, "", 0) for i, (k, p) in enumerate(payloads.items())], SCHEMA)
    want = {"toc_entry": 2, "contributor": 3, "bibl": 1, "author": 2, "editor": 1, "given": 3, "export_check": 1, "dropped": 1, "moved": 1, "missing": 2, "absent_word": 2}
    assert set(want) == set(N.COLUMNS) == {*N.ROOTS.values(), *(k for r in N.REPEATED.values() for k in r.values())}
    rows = {k: N.flat_table(N.record_triples(t, kinds=[k]), k).collect() for k in want}
    assert {k: len(v) for k, v in rows.items()} == want
    assert sorted(r.value for r in rows["given"]) == ["G", "H", "I"] and rows["export_check"][0].missing_chars == '{"a": 1}' and rows["bibl"][0].year == "1999"
    paths = {(r.rec_id, r.node_path) for v in rows.values() for r in v}
    assert all(r.parent_path == "" or (r.rec_id, r.parent_path) in paths for v in rows.values() for r in v)
