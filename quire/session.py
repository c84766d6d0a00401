"""Helpers that depend on the session: the checkpoint folder and cut lineages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the input of a plan for which its own partitions are wide enough for work that is long for each row.
WIDE = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset and the
    master is local. A cluster without one is an error, as its machines share no temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
        spark.conf.set("spark.checkpoint.dir", shared)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder, so that later stages read files and not the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where a small table comes in fewer; large tables stay as
    they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def input_bytes(df: DataFrame) -> int:
    """The bytes of the tables that a plan reads, as Spark estimates them; tables of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def even(df: DataFrame, *keys: str, rows: int | None = None, each: int = 1) -> DataFrame:
    """The same rows by a hash of their keys, in partitions for work that is long for each row: at least three for each
    core, which are not merged for being small in bytes. Where the number of rows is given, a partition has about
    ``each`` of them; else a plan over large tables keeps the partitions that Spark gives it, without a further shuffle."""
    n = 3 * df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        return df.repartition(max(n, -(-rows // each)), *keys)
    return df if input_bytes(df) >= n * WIDE else df.repartition(n, *keys)
