"""Ambiguities among observed paths, before a tree is seeded from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNED = "namespace:"


def provenance(source: Column) -> Column:
    return F.when(F.startswith(source, F.lit(OWNED)), "namespace").otherwise("observed")


def observed(names: DataFrame) -> DataFrame:
    return names.filter(provenance(F.col("source_root_id")) == "observed")


def ambiguous_paths(names: DataFrame) -> DataFrame:
    """(source, path) seen with more than one content."""
    return observed(names).groupBy("source_root_id", "original_relpath").agg(F.count_distinct("cas_id").alias("contents")).filter("contents > 1")


def cross_source_paths(names: DataFrame) -> DataFrame:
    """Paths seen in more than one source."""
    return observed(names).groupBy("original_relpath").agg(F.count_distinct("source_root_id").alias("sources")).filter("sources > 1")


def normalized_collisions(names: DataFrame, key: Column | None = None) -> DataFrame:
    """(source, comparison key) under which paths are spelled in more than one way."""
    keyed = observed(names).withColumn("path_key", F.lower("original_relpath") if key is None else key)
    return keyed.groupBy("source_root_id", "path_key").agg(F.count_distinct("original_relpath").alias("spellings")).filter("spellings > 1")


def control_documents(contents: DataFrame, schema: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Contents that are JSON objects declaring this schema; longer ones are none."""
    small = F.octet_length("content") <= most_bytes
    return contents.filter(small & (F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$.schema", "string") == schema))
