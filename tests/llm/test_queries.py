"""The queries run on the smallest tables and give the columns that are asked for."""

import pytest

from quire.llm.queries import oracle_sql, queries

COLUMNS = {
    "p1_found": ["block_id:bigint", "start_char:int", "end_char:int"], "p2_found": ["name_a:bigint", "name_b:bigint"], "p3_found": ["word_id:bigint", "field_name:string"],
    "p4_found": ["tab:string", "rec_id:bigint"], "p6_ids": ["doc_id:bigint", "ids:array<int>"], "p8_found": ["doc_id:bigint"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    # the smallest tables have no verdict against a document
    assert df.count() > 0 or name == "p8_found"
    if name in COLUMNS:
        assert [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields] == COLUMNS[name]
        assert df.count() == df.distinct().count()


def test_sql_has_queries():
    assert set(oracle_sql()) <= set(queries())
