"""Readers and writers of journals and object trees."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.media import media_type_udf
from sedimenta.functions.names import canonical_line_udf
from sedimenta.operators.validate import parsed

OBJECT = r"objects/sha256/([0-9a-f]{2})/([0-9a-f]{2})/(\1\2[0-9a-f]{60})$"


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON lines; ord counts lines within a file in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return parsed(lines)


def write_journal(journal: DataFrame, path: str) -> None:
    """Canonical lines in order of instant and event_id; sorted by range, so files follow each other."""
    fields = [c for c in journal.columns if c not in ("ord", "at_ts")]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = journal.select(F.try_to_timestamp("at").alias("t"), "event_id", canonical_line_udf(record).alias("value"))
    rows.orderBy("t", "event_id").select("value").write.text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: cas_id (NULL for stray paths), file_size, file_digest, media_type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = F.regexp_extract("path", OBJECT, 3)
    return files.select("path", F.when(digest != "", F.concat(F.lit("sha256:"), digest)).alias("cas_id"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_digest"), media_type_udf("content").alias("media_type"))


def read_ledgers(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all ledgers, diagnostics): a ledger that is missing or malformed is reported and the others are read."""
    rows, notes = None, []
    for path in paths:
        try:
            one = spark.read.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path).withColumn("ledger", F.lit(path))
        except Exception as e:  # noqa: BLE001  the reader raises one class for many causes
            notes.append((path, "missing" if "PATH_NOT_FOUND" in str(e) else "unreadable"))
            continue
        rows = one if rows is None else rows.unionByName(one)
    notes_df = spark.createDataFrame(notes, "ledger string, problem string")
    if rows is None:
        return spark.createDataFrame([], f"{schema}, ledger string"), notes_df
    bad = rows.select("ledger", "__bad").filter("__bad IS NOT NULL").select("ledger", F.lit("invalid").alias("problem")).distinct()
    return rows.filter("__bad IS NULL").drop("__bad"), notes_df.unionByName(bad)
