"""The journal folded into its index: objects, names, totals, receipts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_line_udf
from sedimenta.schemas import JOURNAL, REFINEMENTS


def by_object():
    return Window.partitionBy("cas_id").orderBy("ord")


def earlier():
    return by_object().rowsBetween(Window.unboundedPreceding, -1)


def stored_relpath(cas_id: Column) -> Column:
    digest = F.substring_index(cas_id, ":", -1)
    return F.concat_ws("/", F.lit("objects/sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def objects(journal: DataFrame) -> DataFrame:
    """A row per object: the last media type, the first time and batch, the number of sightings."""
    folded = journal.groupBy("cas_id").agg(F.min("size").alias("size"), F.max_by("media_type", "ord").alias("media_type"), F.min_by("at", "ord").alias("first_seen_utc"), F.min_by("batch", "ord").alias("batch"), F.count("*").alias("n_sightings"))
    return folded.withColumn("stored_relpath", stored_relpath(F.col("cas_id")))


def names(journal: DataFrame) -> DataFrame:
    """A row per sighting (object, source, path): its first time."""
    return journal.groupBy("cas_id", "source_root_id", "original_relpath").agg(F.min_by("at", "ord").alias("recorded_utc"))


def media_conflicts(journal: DataFrame) -> DataFrame:
    """Changes of an object's media type that are no known refinement."""
    before = F.lag("media_type").over(by_object())
    allowed = F.lit(False)
    for old, new in REFINEMENTS:
        allowed = allowed | ((F.col("before") == old) & (F.col("media_type") == new))
    return journal.withColumn("before", before).filter((F.col("before") != F.col("media_type")) & ~allowed).select("cas_id", "event_id", "before", "media_type")


def totals(journal: DataFrame) -> DataFrame:
    """One row; last_ingest is the greatest text, not the latest instant."""
    per_object = journal.groupBy("cas_id").agg(F.min("size").alias("size"), F.max("at").alias("at"))
    return per_object.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("at").alias("last_ingest"))


def outcomes(journal: DataFrame) -> DataFrame:
    """stored for an object's first event, dedup for later ones, with the number of earlier ones."""
    rank = F.row_number().over(by_object())
    return journal.withColumn("rank", rank).select("*", F.when(F.col("rank") == 1, "stored").otherwise("dedup").alias("outcome"), (F.col("rank") - 1).cast("bigint").alias("prior_count")).drop("rank")


def ingest_summary(journal: DataFrame) -> DataFrame:
    new = F.col("outcome") == "stored"
    return outcomes(journal).groupBy("source_root_id").agg(F.count("*").alias("files_seen"), F.count_if(new).alias("new_objects"), F.count_if(~new).alias("dedup_hits"), F.sum("size").alias("logical_bytes"), F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("physical_bytes"))


def dry_run_summary(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Against what is stored before the run only: repeats among the incoming files all count as new."""
    known = stored.select("cas_id").distinct().withColumn("known", F.lit(True))
    marked = incoming.join(known, "cas_id", "left")
    return marked.agg(F.count("*").alias("files_seen"), F.count_if(F.col("known").isNull()).alias("new_objects"), F.count_if("known").alias("dedup_hits"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))


def receipts(journal: DataFrame) -> DataFrame:
    """The last event of each object with what was known before it; prior sightings keep repeats."""
    return (
        journal.withColumn("prior_sightings", F.count("*").over(earlier()))
        .withColumn("first_seen", F.first("at").over(by_object()))
        .withColumn("first_batch", F.first("batch").over(by_object()))
        .withColumn("last", F.lead("ord").over(by_object()).isNull())
        .filter("last")
        .select("cas_id", "event_id", "at", "source_root_id", "original_relpath", "prior_sightings", "first_seen", "first_batch")
    )


def live_prior_names(journal: DataFrame) -> DataFrame:
    """For each event, how many distinct names its object had before: what a receipt counts while the store is live."""
    by_name = Window.partitionBy("cas_id", "source_root_id", "original_relpath").orderBy("ord")
    new = F.when(F.row_number().over(by_name) == 1, 1).otherwise(0)
    return journal.withColumn("new", new).select("event_id", F.coalesce(F.sum("new").over(earlier()), F.lit(0)).alias("prior_names"))


def located(journal: DataFrame) -> DataFrame:
    """The journal with its canonical lines (`line`, without the line feed), their offset, length and digest in the canonical file.

    Offsets are running sums within ranges of ord, plus a row per range for what came before it.
    """
    fields = JOURNAL.fieldNames()
    lines = journal.withColumn("line", canonical_line_udf(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))
    lines = lines.withColumn("length", (F.octet_length("line") + 1).cast("bigint")).withColumn("__part", F.floor(F.col("ord") / 65536))
    inside = Window.partitionBy("__part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier_parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("__part").agg(F.sum("length").alias("__all")).withColumn("__before", F.coalesce(F.sum("__all").over(earlier_parts), F.lit(0)))
    placed = lines.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(parts.drop("__all"), "__part")
    digest = F.sha2(F.concat("line", F.lit("\n")).cast("binary"), 256)
    return placed.withColumn("offset", F.col("offset") + F.col("__before")).withColumn("sha256", digest).drop("__part", "__before")


def witness(located: DataFrame) -> DataFrame:
    """Per object, its records' number and the digest of their located rows (event_id, offset, length, sha256) in order.

    The digest of one object's rows is one text by its definition: about 150 bytes for each sighting of the object.
    """
    row = F.concat_ws("\t", "event_id", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256")
    rows = located.groupBy("cas_id").agg(F.count("*").alias("records"), F.array_sort(F.collect_list(F.struct("offset", F.concat(row, F.lit("\n")).alias("row")))).alias("rows"))
    return rows.select("cas_id", "records", F.sha2(F.array_join("rows.row", "").cast("binary"), 256).alias("digest"))


def digest_of(lines: DataFrame) -> DataFrame:
    """lines: block, order, line. One row: records, digest."""
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda r: r["line"]), "\n"), F.lit("\n"))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.sha2(joined.cast("binary"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"]), "")
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(whole.cast("binary"), 256).alias("digest"))


def journal_commitment(journal: DataFrame, block: int = 4096) -> DataFrame:
    """records, digest of the journal's canonical lines in order, in blocks of ord."""
    lines = located(journal).select(F.floor(F.col("ord") / block).alias("block"), F.col("ord").alias("order"), "line")
    return digest_of(lines)


def diagnosis(journal: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts and the journal's commitment."""
    live = entries.agg(F.count_if(F.col("live") == 1).alias("live_entries"), F.count_if(F.col("live") == 0).alias("deleted_entries"))
    return journal_commitment(journal).join(live)
