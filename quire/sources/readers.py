"""Sources beside the Parquet tables: page selections, canonical JSON and XML files, profiles, raw files, a cache."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint_dir
from quire.sources.sinks import read_canonical


def parse_pages(spec: str, most: int = 10_000) -> list[int]:
    """"1-3,5" as [1, 2, 3, 5]: sorted, without repeats; a ValueError for anything else or too many."""
    found: set[int] = set()
    for part in spec.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not lo.isdigit() or (dash and not hi.isdigit()):
            raise ValueError(f"no page selection: {part!r}")
        a, b = int(lo), int(hi or lo)
        if a < 1 or b < a or b - a >= most:
            raise ValueError(f"no page range: {part!r}")
        found.update(range(a, b + 1))
        if len(found) > most:
            raise ValueError("too many pages")
    return sorted(found)


def select_pages(df: DataFrame, spec: str | None) -> DataFrame:
    """The rows on the selected pages; the predicate reaches the scan."""
    return df if not spec else df.where(F.col("page").isin(parse_pages(spec)))


def preflight(meta: DataFrame, most_pages: int) -> DataFrame:
    """``doc_id, accepted, reason``: documents that are rejected before anything is read from them."""
    reason = F.when(F.col("pages").isNull() | (F.col("pages") < 1), "no pages").when(F.col("pages") > most_pages, "too many pages")
    return meta.select("doc_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Canonical JSON, one row a line."""
    return read_canonical(spark.read.text(path).withColumnRenamed("value", "json"), schema)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """XML files by element; broken records come out with nulls and not as a failure."""
    r = spark.read.option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).xml(path)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, sha256, length, content`` of raw files; content is read only where it is selected."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return b.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two folders by the stem of their names, letter case aside."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return left.withColumn("stem", stem).alias("a").join(right.withColumn("stem", stem).alias("b"), "stem").select("stem", F.col("a.path").alias("left_path"), F.col("b.path").alias("right_path"))


def load_profile(path: str, allowed: dict[str, type]) -> dict:
    """A profile from JSON or YAML: a closed set of keys with their types."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML can't be read here") from e
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    for k, v in data.items():
        if k not in allowed or not isinstance(v, allowed[k]):
            raise ValueError(f"not allowed in a profile: {k}")
    return data


def cached(spark: SparkSession, identity: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under the hash of its identity in the shared folder; built where it isn't there whole."""
    key = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
    path = f"{checkpoint_dir(spark).rstrip('/')}/cache-{key}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Registry(dict):
    """Named readers, with one to fall back on where the wanted one isn't there."""

    def get_reader(self, name: str, fallback: str | None = None):
        if name in self:
            return self[name]
        if fallback in self:
            return self[fallback]
        raise KeyError(f"no reader {name}; there are {', '.join(sorted(self))}")
