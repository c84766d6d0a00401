"""The ledger of dropped text: why a block that is missing from an export isn't there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars as S


def missing_reasons(triples: DataFrame) -> DataFrame:
    """``rec_id, node_path, how, reason``: of each missing node the reason of a dropped one of its record and page, of the
    same letters (``exact``) or else of letters that contain those of the missing one (``contained``, at least 4); null if
    there is none. Of several the first reason counts. Joined by record and page, which a page's blocks bound."""
    value = lambda c: F.max(F.when(F.col("field") == c, F.col("value"))).alias(c)
    n = triples.where(F.col("node_kind").isin("dropped", "missing")).groupBy("rec_id", "node_kind", "node_path").agg(value("page"), value("text"), value("reason"))
    n = n.withColumn("k", S.alnum_key(F.coalesce("text", F.lit(""))))
    d = n.where((F.col("node_kind") == "dropped") & (F.col("k") != "")).groupBy("rec_id", "page", "k").agg(F.min("reason").alias("reason"))
    d = d.select(F.col("rec_id").alias("dr"), F.col("page").alias("dp"), F.col("k").alias("dk"), "reason")
    m = n.where(F.col("node_kind") == "missing").select("rec_id", "node_path", "page", "k")
    same = (F.col("k") == F.col("dk")) | ((F.length("k") >= 4) & F.col("dk").contains(F.col("k")))
    met = m.join(d, F.col("rec_id").eqNullSafe(F.col("dr")) & F.col("page").eqNullSafe(F.col("dp")) & same, "left")
    order = F.when(F.col("k") == F.col("dk"), 0).when(F.col("dk").isNotNull(), 1)
    best = met.groupBy("rec_id", "node_path").agg(F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), "reason"))).alias("b"))
    return best.select("rec_id", "node_path", F.when(F.col("b.o") == 0, "exact").when(F.col("b.o") == 1, "contained").alias("how"), F.col("b.reason").alias("reason"))
