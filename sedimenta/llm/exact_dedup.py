"""Exact deduplication by content-defined chunk recipes.

1. Each text, lower-cased in A-Z only, is cut into chunks where a rolling hash of its last 16 bytes hits a pattern, so
   that equal passages give equal chunks wherever they stand. Chunks have min_chunk to max_chunk bytes.
2. Chunks are deduplicated by (hash, bytes): bytes are compared, so an identifier names one content. This grouping is
   combined before its shuffle, so a chunk that a third of all rows share leaves one row per task; it is the only time
   that text is moved. Where two contents share a hash (`hash_bits` is 63; tests lower it), their rank within the hash
   becomes part of the identifier.
3. A text's recipe is the ordered list of its chunk identifiers; two texts are equal exactly if their recipes are.
   Recipes, not texts, are grouped and joined. The join back to all documents is salted by row, for a hot group.

Defined results: a null text is empty; the empty recipe is a recipe; of equal texts the largest doc_id stays, null ids
last; rows that repeat id and text are copies of one document and share its fate (each is kept if the id is keep_id);
where all ids of a group are null, keep_id is null and each row is kept. An empty table gives no row. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, sliced, utf8

RECIPES = "doc_id bigint, text_sha256 string, ids array<bigint>, chunks array<binary>"
SALTS = 32


def boundaries(data: bytes, min_chunk: int, average: int, max_chunk: int) -> list[int]:
    """Ends of the chunks of data. A cut depends on the 16 bytes before it and on the cut before that."""
    n = len(data)
    if n <= min_chunk:
        return [n] if n else []
    h = np.frombuffer(data, np.uint8).astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    for shift in (1, 2, 4, 8):  # after these, each place has mixed its last 16 bytes
        h[shift:] = h[shift:] + (h[:-shift] * np.uint32(0x85EBCA6B + 2 * shift))
        h ^= h >> np.uint32(15)
    places = (np.flatnonzero((h[16:] & np.uint32(average - 1)) == 0) + 17).tolist()
    ends, last = [], 0
    for p in places:
        while p - last > max_chunk:
            last += max_chunk
            ends.append(last)
        if p - last >= min_chunk:
            ends.append(p)
            last = p
    while n - last > max_chunk:
        last += max_chunk
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def recipes(documents: DataFrame, min_chunk: int = 512, average: int = 2048, max_chunk: int = 16384, hash_bits: int = 63) -> DataFrame:
    mask = (1 << hash_bits) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shas, ids, chunks = [], [], []
            for value in batch.column(1):
                data = value.as_py().lower()  # bytes.lower() knows A-Z only
                shas.append(hashlib.sha256(data).hexdigest())
                ends = boundaries(data, min_chunk, average, max_chunk)
                own = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                chunks.append(own)
                ids.append([int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little") & mask for c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.binary()))], names=["doc_id", "text_sha256", "ids", "chunks"])

    return documents.select("doc_id", utf8().alias("text")).mapInArrow(cut, RECIPES)


def verified(found: DataFrame) -> DataFrame:
    """Recipes whose identifiers are verified: doc_id, text_sha256, recipe (array of structs id, rank)."""
    pairs = found.select(F.explode(F.arrays_zip("ids", "chunks")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.chunks").alias("bytes"))
    contents = pairs.groupBy("id", "bytes").agg(F.count("*").alias("n"))
    clashing = persisted(contents.groupBy("id").agg(F.count("*").alias("contents")).filter("contents > 1").select("id"), "clashing")
    plain = found.select("doc_id", "text_sha256", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(0).alias("rank"))).alias("recipe"))
    if clashing.isEmpty():
        return plain
    ranks = contents.join(clashing, "id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("bytes")) - 1).drop("n")
    placed = found.withColumn("uid", F.monotonically_increasing_id())
    placed = persisted(placed, "placed")
    parts = placed.select("uid", "doc_id", "text_sha256", F.posexplode_outer(F.arrays_zip("ids", "chunks")).alias("pos", "c")).select("uid", "doc_id", "text_sha256", "pos", F.col("c.ids").alias("id"), F.col("c.chunks").alias("bytes"))
    ranked = parts.join(ranks, ["id", "bytes"], "left").select("uid", "doc_id", "text_sha256", F.when(F.col("pos").isNotNull(), F.struct("pos", F.struct("id", F.coalesce("rank", F.lit(0)).alias("rank")).alias("e"))).alias("at"))
    return ranked.groupBy("uid", "doc_id", "text_sha256").agg(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["e"]).alias("recipe")).drop("uid")


def exact_duplicates(documents: DataFrame, **chunking: int) -> DataFrame:
    """documents: doc_id, text. One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = persisted(recipes(documents, **chunking), "recipes")
    rows = verified(found)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["recipe", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
