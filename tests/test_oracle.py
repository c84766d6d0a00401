"""Every query with SQL gives the same rows as DuckDB; every other one runs."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from quire.plans.queries import oracle_sql, queries


def normal(df):
    df = df[sorted(df.columns)].copy()

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    for c in df.columns:
        df[c] = df[c].map(text).replace({"True": "1", "False": "0"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    own, other = normal(queries()[name](spark, sf).toPandas()), normal(duck.sql(oracle_sql()[name]).df())
    assert list(own.columns) == list(other.columns)
    pd.testing.assert_frame_equal(own, other, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() >= 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
