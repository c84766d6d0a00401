"""The queries of the core operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import nested
from quire.plans import audit, book, flow, jobs, layout, links, more, outputs, pages, structure, texts  # noqa: F401
from quire.plans.registry import QUERIES, SQL, query
from quire.sources.tables import table


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nodes(table(spark, sf, "raw_records"))


def _flat(kind: str):
    """The query of one node kind's table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return nested.flat_table(nested.record_triples(table(spark, sf, "raw_records"), kinds=[kind]), kind)

    return run


TABLES = {
    "p5_toc_entries": "toc_entry", "p5_contributors": "contributor", "p5_bibls": "bibl", "p5_authors": "author", "p5_editors": "editor", "p5_given_names": "given",
    "p5_export_checks": "export_check", "p5_dropped": "dropped", "p5_moved": "moved", "p5_missing": "missing", "p5_absent_words": "absent_word",
}
for _name, _kind in TABLES.items():
    query(name=_name)(_flat(_kind))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
