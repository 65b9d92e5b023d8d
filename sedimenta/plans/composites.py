"""Composite plans: merging replicas, migrating journals, reports over traces."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_line_udf
from sedimenta.functions.scalars import migrated_event_id
from sedimenta.operators import index, intervals, verify
from sedimenta.schemas import JOURNAL, JOURNAL_SCHEMA, V1_JOURNAL


class MergeRefused(ValueError):
    """Replicas that hold different records under one id, or different sizes for one object."""


def merge(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(journal, objects, what to publish to the target); nothing is written, refusals come first."""
    if not verify.merge_conflicts(target, source).isEmpty():
        raise MergeRefused("event-conflict")
    plan = verify.merge_plan(target, source)
    if not plan.filter("size_conflict").isEmpty():
        raise MergeRefused("size-conflict")
    journal = verify.merge_union(target, source)
    return journal, index.objects(journal), plan.filter("holder = 'source'").select("cas_id")


def migrate_v1(records: DataFrame) -> DataFrame:
    """Ten-field records (V1_JOURNAL) with `ord`, their line's ordinal from 1: ids follow from the ordinal and the whole record, mtime goes."""
    line = canonical_line_udf(F.to_json(F.struct(*V1_JOURNAL.fieldNames()), {"ignoreNullFields": "false"}))
    rows = records.withColumn("event_id", migrated_event_id(F.col("ord"), line)).withColumn("schema", F.lit(JOURNAL_SCHEMA))
    return rows.select("ord", *JOURNAL.fieldNames())


def trace_report(spans: DataFrame) -> DataFrame:
    """A row per group: metrics, coverage and the exclusive time of each category."""
    by_category = intervals.exclusive(spans).groupBy("g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "exclusive")))).alias("exclusive"))
    return intervals.group_metrics(spans).join(intervals.coverage(spans), "g").join(by_category, "g", "left")


def seed_observation(names: DataFrame) -> dict[str, DataFrame]:
    from sedimenta.operators import onboard

    return {"ambiguous": onboard.ambiguous_paths(names), "cross_source": onboard.cross_source_paths(names), "normalized": onboard.normalized_collisions(names)}
