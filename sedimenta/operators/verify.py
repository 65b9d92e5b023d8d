"""Integrity as set algebra: statuses, drift, missing and extra objects; unions of replicas and their conflicts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A status's exit code, by precedence.
EXIT_CODES = {"missing": 11, "corrupt": 10, "drift": 12, "ok": 0}


def statuses(objects: DataFrame, files: DataFrame) -> DataFrame:
    """objects: cas_id, size. files: cas_id, file_size, file_digest, regular, readable, writable. The first fault of each object."""
    status = (
        F.when(F.col("file_size").isNull(), "missing")
        .when(~F.col("regular"), "not regular")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("file_size") != F.col("size"), "size mismatch")
        .when(F.col("writable"), "writable")
        .when(F.col("file_digest") != F.substring_index("cas_id", ":", -1), "digest mismatch")
        .otherwise("ok")
    )
    return objects.join(files, "cas_id", "left").select("cas_id", status.alias("status"))


def exit_code(statuses: DataFrame, drifted: bool = False) -> int:
    """missing before corrupt before drift before ok."""
    row = statuses.agg(F.coalesce(F.max(F.col("status") == "missing"), F.lit(False)), F.coalesce(F.max(~F.col("status").isin("missing", "ok")), F.lit(False))).first()
    return EXIT_CODES["missing" if row[0] else "corrupt" if row[1] else "drift" if drifted else "ok"]


def sample(objects: DataFrame, n: int) -> DataFrame:
    """The n first objects by id; a sample that reruns repeat."""
    return objects.orderBy("cas_id").limit(n)


def bag_difference(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """Rows that one bag has more often than the other, with the side and how often; one pass over both."""
    columns = stored.columns
    both = stored.withColumn("__d", F.lit(1)).unionByName(folded.withColumn("__d", F.lit(-1)))
    counts = both.groupBy(*columns).agg(F.sum("__d").alias("d")).filter("d <> 0")
    return counts.select(*columns, F.when(F.col("d") > 0, "stored").otherwise("folded").alias("side"), F.abs("d").cast("bigint").alias("times"))


def one_sided(journal: DataFrame, tree: DataFrame) -> DataFrame:
    """Objects in the journal but not in the tree, and the other way round."""
    j, t = journal.select("cas_id").distinct(), tree.select("cas_id").distinct()
    return j.join(t, "cas_id", "left_anti").withColumn("side", F.lit("journal only")).unionByName(t.join(j, "cas_id", "left_anti").withColumn("side", F.lit("tree only")))


def merge_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by whole record: commutative, associative, idempotent."""
    return a.unionByName(b).distinct()


def merge_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Event ids under which the replicas hold different records; any of them refuses the merge."""
    return merge_union(a, b).groupBy("event_id").agg(F.count("*").alias("versions")).filter("versions > 1")


def merge_plan(target: DataFrame, source: DataFrame) -> DataFrame:
    """Per object, who holds it, and whether the sizes agree."""
    t = target.groupBy("cas_id").agg(F.min("size").alias("target_size"))
    s = source.groupBy("cas_id").agg(F.min("size").alias("source_size"))
    holder = F.when(F.col("source_size").isNull(), "target").when(F.col("target_size").isNull(), "source").otherwise("both")
    return t.join(s, "cas_id", "full_outer").select("cas_id", holder.alias("holder"), F.coalesce(F.col("target_size") != F.col("source_size"), F.lit(False)).alias("size_conflict"))


def same_epoch(a: dict, b: dict) -> str | None:
    """The first refusal, or None: replicas must differ in store_id and agree in lineage, epoch, generation, predecessor."""
    if a["store_id"] == b["store_id"]:
        return "same-store"
    for field, code in (("lineage_id", "lineage-mismatch"), ("epoch_id", "epoch-mismatch"), ("generation", "generation-mismatch"), ("predecessor_epoch_id", "predecessor-mismatch")):
        if a[field] != b[field]:
            return code
    return None
