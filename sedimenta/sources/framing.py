"""Journals as bytes: lines with their offsets, spans read back with proof, the tail; and folders taken in as journals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.media import media_type_udf
from sedimenta.operators.lineage import cut, numbered
from sedimenta.operators.validate import parsed_v1
from sedimenta.schemas import JOURNAL_SCHEMA

FRAMES = "path string, offset bigint, length bigint, sha256 string, line string"


def framed(files: DataFrame) -> DataFrame:
    """files: path, content. A row per line, cut where text lines end (LF, CR, CRLF, VT, FF, FS, GS, RS, NEL, U+2028, U+2029):
    offset and length in bytes, the end with the line, and its digest. A file that is no UTF-8 has one row with line NULL.

    A journal of many files is framed file by file; one file must fit into a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                rows: list[tuple] = []
                try:
                    at = 0
                    for line in data.decode("utf-8").splitlines(keepends=True):
                        raw = line.encode()
                        rows.append((path, at, len(raw), hashlib.sha256(raw).hexdigest(), line))
                        at += len(raw)
                except UnicodeDecodeError:
                    rows = [(path, 0, len(data), hashlib.sha256(data).hexdigest(), None)]
                for i in range(0, len(rows), 20_000):
                    part = [*zip(*rows[i : i + 20_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "offset", "length", "sha256", "line"])

    return files.select("path", "content").mapInArrow(run, FRAMES)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return framed(spark.read.format("binaryFile").load(path).select("path", "content"))


def proven(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans: path, offset, length, sha256. The bytes that stand there (`found`), and whether their digest is the one on record."""
    joined = spans.join(files.select("path", "content"), "path", "left")
    found = F.expr("substring(content, CAST(offset + 1 AS INT), CAST(length AS INT))")
    return joined.withColumn("found", found).withColumn("proven", F.coalesce(F.sha2("found", 256) == F.col("sha256"), F.lit(False))).drop("content")


def tail(frames: DataFrame) -> DataFrame:
    """The last line of each file, and whether it is terminated: only then may anything be appended."""
    last = frames.groupBy("path").agg(F.max_by(F.struct("offset", "length", "sha256", "line"), "offset").alias("t"))
    return last.select("path", "t.*").withColumn("terminated", F.coalesce(F.endswith("line", F.lit("\n")), F.lit(False)))


def read_v1_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of one journal of the first format; ord counts its physical lines from 1."""
    lines = numbered(read_frames(spark, path).select("path", "offset", F.regexp_replace("line", r"[\r\n]+$", "").alias("line")), "path", "offset", name="ord")
    return parsed_v1(lines.select("ord", "line"))


def minted(rows: DataFrame, after: str, *order: str) -> DataFrame:
    """rows with `at`: times that strictly increase in the order of the columns, each a microsecond after the one before, all after `after`."""
    base = F.unix_micros(F.to_timestamp(F.lit(after)))
    at = F.timestamp_micros(base + F.col("__n"))
    return numbered(rows, *order, name="__n").withColumn("at", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).drop("__n")


def ingest(spark: SparkSession, path: str, source_root_id: str, stored: DataFrame, after: str, batch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder, or one file, as (journal records, new objects with their content, refused paths).

    stored: cas_id of what the store holds. The first file of a content that is not stored is `stored`, all others
    `dedup`. Refused are paths that a journal may not hold. The session's time zone must be UTC.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/")
    relative = F.regexp_replace("path", r"^(?:file:)?/*" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in base.lstrip("/")) + "/?", "")
    rows = files.select(F.when(relative == "", F.substring_index("path", "/", -1)).otherwise(relative).alias("original_relpath"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("cas_id"), F.col("length").alias("size"), media_type_udf("content").alias("media_type"), "content")
    unsafe = F.array_contains(F.split("original_relpath", "/"), "..") | F.startswith("original_relpath", F.lit("/"))
    refused = rows.filter(unsafe).select("original_relpath", F.lit("unsafe path").alias("reason"))
    good = rows.filter(~unsafe)
    timed = cut(minted(good.drop("content"), after, "original_relpath").withColumn("event_id", F.concat(F.lit("uuid:"), F.expr("uuid()"))))
    known = stored.select("cas_id").distinct().withColumn("__known", F.lit(True))
    firsts = timed.groupBy("cas_id").agg(F.min_by("event_id", "at").alias("__first"))
    outcome = F.when(F.col("__known").isNull() & (F.col("event_id") == F.col("__first")), "stored").otherwise("dedup")
    journal = timed.join(known, "cas_id", "left").join(firsts, "cas_id").select(
        F.lit(JOURNAL_SCHEMA).alias("schema"), "event_id", "at", F.lit("ingest").alias("event"), "cas_id", "size", "media_type", F.lit(source_root_id).alias("source_root_id"), "original_relpath", F.lit(batch).cast("string").alias("batch"), outcome.alias("outcome")
    )
    objects = good.join(known, "cas_id", "left_anti").dropDuplicates(["cas_id"]).select("cas_id", "size", "content")
    return journal, objects, refused
