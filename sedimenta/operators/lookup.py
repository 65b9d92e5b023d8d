"""Point lookups, search, pages and the change feed."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.names import comparison_key
from sedimenta.operators.tree import with_key


def names_for(names: DataFrame, cas_id: str) -> DataFrame:
    return names.filter(F.col("cas_id") == cas_id)


def find_names(names: DataFrame, needle: str) -> DataFrame:
    """Names whose path holds the needle, as it is written; an empty needle is in every path."""
    return names.filter(F.instr("original_relpath", needle) > 0).orderBy("original_relpath", "cas_id")


def object_stat(objects: DataFrame, names: DataFrame) -> DataFrame:
    own = names.groupBy("cas_id").agg(F.array_sort(F.collect_list(F.struct("source_root_id", "original_relpath"))).alias("names"))
    return objects.join(own, "cas_id", "left")


def receipt_for(journal: DataFrame, cas_id: str, source: str | None = None, relpath: str | None = None) -> DataFrame:
    """The last event that matches."""
    rows = journal.filter(F.col("cas_id") == cas_id)
    for column, value in (("source_root_id", source), ("original_relpath", relpath)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.col("ord").desc()).limit(1)


def choose_name(names: DataFrame, wanted: str) -> DataFrame:
    """Per wanted name: the path that equals it, else the only one with that last component; `ambiguous` where several have it."""
    exact = F.col("original_relpath") == wanted
    last = F.substring_index("original_relpath", "/", -1) == wanted
    found = names.filter(exact | last).agg(F.min(F.when(exact, F.col("original_relpath"))).alias("exact"), F.count_distinct(F.when(last, F.col("cas_id"))).alias("n"), F.min(F.when(last, F.col("original_relpath"))).alias("only"))
    return found.select(F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("chosen"), (F.col("exact").isNull() & (F.col("n") > 1)).alias("ambiguous"))


def directory_page(entries: DataFrame, parent: str, after: str | None, limit: int) -> DataFrame:
    """Live children with names past `after` by comparison key, in order; `next_name` is the page's last name if there are more."""
    rows = with_key(entries.filter((F.col("parent_id") == parent) & (F.col("live") == 1)))
    if after is not None:
        rows = rows.filter(F.col("comparison_key") > comparison_key(after))
    page = rows.orderBy("comparison_key", "entry_id").limit(limit + 1)
    order = Window.orderBy("comparison_key", "entry_id")  # limit + 1 rows at most
    numbered = page.withColumn("rn", F.row_number().over(order)).withColumn("more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return numbered.filter(F.col("rn") <= limit).withColumn("next_name", F.when(F.col("more") & (F.col("rn") == limit), F.col("name"))).select("entry_id", "kind", "name", "next_name")


def changes_since(entries: DataFrame, revision: int, entry_id: str, limit: int, generation: str | None = None, current: str | None = None) -> DataFrame:
    """Entries touched past the cursor (revision, entry_id), deleted ones too; the plain comparison reaches the scan.

    The page's last row carries the next cursor (next_revision, next_entry_id) if there are more. A cursor of another
    generation than the current one is refused.
    """
    if generation != current:
        raise ValueError(f"revision-conflict: generation {generation} is not {current}")
    past = F.struct("touched_revision", "entry_id") > F.struct(F.lit(revision).cast("bigint"), F.lit(entry_id))
    page = entries.filter((F.col("touched_revision") >= revision) & past).orderBy("touched_revision", "entry_id").limit(limit + 1)
    order = Window.orderBy("touched_revision", "entry_id")  # limit + 1 rows at most
    numbered = page.withColumn("rn", F.row_number().over(order)).withColumn("more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    last = F.col("more") & (F.col("rn") == limit)
    return numbered.filter(F.col("rn") <= limit).select("touched_revision", "entry_id", "kind", "live", F.when(last, F.col("touched_revision")).alias("next_revision"), F.when(last, F.col("entry_id")).alias("next_entry_id"))


def recent(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Per group the n last rows; ordered by group, oldest first."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col("span_id").desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn").orderBy(by, order, "span_id")


def epoch_at(points: DataFrame, epochs: DataFrame, revision: str = "revision", start: str = "start", width: int = 4096) -> DataFrame:
    """The epoch in force at each point: the last that starts at or before it.

    No range join: points and epochs meet in buckets of revisions, where a running last value finds the epoch; what an
    earlier bucket hands on is a row per bucket.
    """
    kind = epochs.select(F.struct(*epochs.columns).alias("e")).schema["e"].dataType
    bucket = lambda c: F.floor(F.col(c) / width)
    left = points.select(F.col(revision).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__point"), F.lit(None).cast(kind).alias("__epoch"))
    right = epochs.select(F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__point"].dataType).alias("__point"), F.struct(*epochs.columns).alias("__epoch"))
    both = left.unionByName(right).withColumn("__bucket", bucket("__at"))
    edges = both.groupBy("__bucket").agg(F.max_by("__epoch", F.when(F.col("__epoch").isNotNull(), F.col("__at"))).alias("__own"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__carried", F.last("__own", ignorenulls=True).over(earlier)).drop("__own")
    inside = Window.partitionBy("__bucket").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__epoch", F.last("__epoch", ignorenulls=True).over(inside)).filter("__kind = 1").join(edges, "__bucket")
    found = found.withColumn("__epoch", F.coalesce("__epoch", "__carried"))
    return found.select("__point.*", *(F.col(f"__epoch.{c}").alias(c if c != start else f"epoch_{start}") for c in epochs.columns))
