"""The queries of the problems on text, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import abuse, bpe, confusables, mojibake, names, packing, sentences
from quire.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.block_sentences(table(spark, sf, "text_blocks"), table(spark, sf, "aruns"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.same_names(table(spark, sf, "bib_names"))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.entities(table(spark, sf, "bib_names"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.damaged_words(table(spark, sf, "words")).select("word_id", "field_name")


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.damaged_words(table(spark, sf, "words"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.look_alikes(table(spark, sf, "words"), table(spark, sf, "text_blocks"))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.forms(table(spark, sf, "words"), table(spark, sf, "text_blocks"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf, "documents"))


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "containers"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.abusive(table(spark, sf, "documents"), table(spark, sf, "review_labels"))


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scored(table(spark, sf, "documents"), table(spark, sf, "review_labels"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(table(spark, sf, "documents"), table(spark, sf, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_forms": p4_forms, "p6_ids": p6_ids, "p7_packing": p7_packing, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {}
