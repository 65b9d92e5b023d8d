"""Snapshots: manifests of a tree at a revision, published as content and kept in a catalog.

members: snapshot_id and an entry's fields, a row per entry; catalog: snapshot_id, cas_id, size, captured_revision, live.
A manifest is one JSON text by its definition, kept in parts, so it may have any length; over_limits tells those that the
published format refuses. Members hold the same as rows, and everything but publishing works on those.
"""

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_bytes_udf
from sedimenta.operators.lineage import cut
from sedimenta.operators.tree import ENTRY, entry_json, paths
from sedimenta.schemas import MOST_ENTRIES, MOST_MANIFEST_BYTES, SNAPSHOT_SCHEMA

HEADER = ("captured_revision", "cas_binding", "namespace_id", "origin", "policy", "root_id", "schema")
_ENTRY_FIELDS = "entry_id string, kind string, parent_id string, name string, metadata string, cas_id string, size bigint, changed_revision bigint"
_ENTRIES = f"array<struct<{_ENTRY_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
#: The number of a manifest's last part; characters after which a part ends.
LAST, PART_BYTES = 2**63 - 1, 1 << 12


def header(namespace_id: str, policy: str, revision: int, root_id: str, binding: dict, origin: dict | None = None, schema: str = SNAPSHOT_SCHEMA) -> tuple[str, str]:
    """The canonical text around a manifest's entries."""
    fields = {"captured_revision": revision, "cas_binding": binding, "namespace_id": namespace_id, "origin": origin or {"kind": "capture"}, "policy": policy, "root_id": root_id, "schema": schema}
    text = lambda keys: ",".join(f"{json.dumps(k)}:{json.dumps(fields[k], sort_keys=True, separators=(',', ':'), ensure_ascii=False)}" for k in keys)
    return "{" + text(HEADER[:2]) + ',"entries":[', "]," + text(HEADER[2:]) + "}\n"


def manifests(members: DataFrame, before: Column, after: Column) -> DataFrame:
    """Each snapshot's manifest in parts: snapshot_id, number, n, text; before and after are the texts around its entries.

    Part 0 is the text before the entries, part LAST the one after them; those between, in the order of their numbers
    (which have gaps), hold n entries each, and the manifest joins them with commas. Entries are sorted and put into parts
    by ranges, so no task holds a manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, owner = [], 0, None
        for batch in batches:
            out = []
            for snapshot, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (snapshot != owner or size >= PART_BYTES):
                    out.append((owner, len(held), ",".join(held)))
                    held, size = [], 0
                owner = snapshot
                held.append(line)
                size += len(line)
            yield _rows(out)
        yield _rows([(owner, len(held), ",".join(held))] if held else [])

    dealt = members.select("snapshot_id", "entry_id", entry_json().alias("json")).repartitionByRange("snapshot_id", "entry_id")
    lines = dealt.withColumn("line", F.substring_index(canonical_bytes_udf("json").cast("string"), "\n", 1)).filter("line IS NOT NULL")
    ordered = lines.sortWithinPartitions("snapshot_id", "entry_id", "line").select("snapshot_id", "line")
    inner = ordered.mapInArrow(run, "snapshot_id string, n bigint, text string").select("snapshot_id", (F.monotonically_increasing_id() + 1).alias("number"), "n", "text")
    around = members.groupBy("snapshot_id").agg(F.first(before).alias("b"), F.first(after).alias("a"))
    ends = around.select("snapshot_id", F.inline(F.array(*(F.struct(F.lit(number).cast("bigint").alias("number"), F.lit(0).cast("bigint").alias("n"), F.col(text).alias("text")) for number, text in ((0, "b"), (LAST, "a"))))))
    return cut(inner.unionByName(ends))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([("snapshot_id", pa.string()), ("n", pa.int64()), ("text", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.types[i]) for i in range(3)], schema=kinds)


def digests(parts: DataFrame) -> DataFrame:
    """snapshot_id, cas_id, size of each snapshot's manifest. A digest is sequential, so one task reads a snapshot's parts, but one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, n, t) for batch in batches for i, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for snapshot, own in groupby(rows, lambda row: row[0]):
            digest, size, entries = hashlib.sha256(), 0, False
            for _, n, text in own:
                data = ("," if n and entries else "").encode() + text.encode()
                entries = entries or n > 0
                digest.update(data)
                size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([snapshot], pa.string()), pa.array([f"sha256:{digest.hexdigest()}"]), pa.array([size], pa.int64())], names=["snapshot_id", "cas_id", "size"])

    return parts.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "number").select("snapshot_id", "n", "text").mapInArrow(run, "snapshot_id string, cas_id string, size bigint")


def over_limits(parts: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_MANIFEST_BYTES) -> DataFrame:
    """snapshot_id, entries, bytes of manifests that the published format refuses for their length."""
    inner = F.when(F.col("n") > 0, 1).otherwise(0)
    sums = parts.groupBy("snapshot_id").agg(F.sum("n").alias("entries"), (F.sum(F.octet_length("text")) + F.greatest(F.sum(inner) - 1, F.lit(0))).alias("bytes"))
    return sums.filter((F.col("entries") > most_entries) | (F.col("bytes") > most_bytes))


def capture(entries: DataFrame, snapshot_id: str, revision: int, text: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, catalog row, parts of the manifest) of all live entries; the catalog row belongs to revision + 1."""
    whole = entries.filter("live = 1")
    for column, kind in (("metadata", "string"), ("cas_id", "string")):
        if column not in whole.columns:
            whole = whole.withColumn(column, F.lit("{}" if column == "metadata" else None).cast(kind))
    members = whole.select(F.lit(snapshot_id).alias("snapshot_id"), *ENTRY)
    parts = manifests(members, F.lit(text[0]), F.lit(text[1]))
    row = digests(parts).withColumn("captured_revision", F.lit(revision).cast("bigint")).withColumn("live", F.lit(1))
    return members, row, parts


def decode(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts: as of manifests. (members, errors): manifests whose keys are not exactly the declared ones are errors.

    The texts around the entries must be a manifest without entries, and each part between a list of entries by itself;
    then the joined text is a manifest, and parts are read side by side. Errors, a row per refused manifest, are broadcast.
    """
    end = F.col("number").isin(0, LAST)
    outer = parts.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(end, F.struct("number", "text")))), lambda x: x["text"]), "").alias("content"))
    sound = F.coalesce(F.json_array_length(F.get_json_object("content", "$.entries")) == 0, F.lit(False))
    known = F.array_sort(F.json_object_keys("content")).eqNullSafe(F.array(*map(F.lit, sorted((*HEADER, "entries")))))
    outer = outer.select("snapshot_id", F.when(~known, "keys").when(~sound, "entries").alias("error"))
    listed = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    inner = parts.filter(~end).withColumn("e", F.from_json(listed, _ENTRIES))
    whole = (F.json_array_length(listed) == F.col("n")) & (F.size("e") == F.col("n"))
    torn = inner.filter(~F.coalesce(whole, F.lit(False))).select("snapshot_id", F.lit("entries").alias("error"))
    errors = outer.filter("error IS NOT NULL").unionByName(torn).groupBy("snapshot_id").agg(F.max("error").alias("error"))
    members = inner.select("snapshot_id", F.explode("e").alias("e")).select("snapshot_id", "e.*")
    return members.join(F.broadcast(errors), "snapshot_id", "left_anti"), errors


def inspect(catalog: DataFrame, members: DataFrame, snapshot_id: str) -> DataFrame:
    """A live snapshot's members beside its catalog row; no row if there is no such snapshot."""
    return catalog.filter((F.col("snapshot_id") == snapshot_id) & (F.col("live") == 1)).select("snapshot_id", "captured_revision").join(members, "snapshot_id")


def exported(members: DataFrame) -> DataFrame:
    """Where each member of one snapshot goes in a folder: path, kind, cas_id, size; shorter paths, so directories, come first."""
    placed = paths(members).join(members.select("entry_id", "kind", "cas_id", "size"), "entry_id").filter("depth > 0")
    return placed.select(F.substr("path", F.lit(2)).alias("path"), "kind", "cas_id", "size").orderBy("path")


def deleted(catalog: DataFrame, snapshot_id: str) -> DataFrame:
    """The catalog without this snapshot among the live ones; its content stays."""
    return catalog.withColumn("live", F.when(F.col("snapshot_id") == snapshot_id, 0).otherwise(F.col("live")))


def uncovered(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """Snapshots without an action, and actions without a snapshot; any refuses an excision."""
    a, b = catalog.select("snapshot_id", F.lit(True).alias("known")), actions.select("snapshot_id", F.lit(True).alias("asked"))
    both = a.join(b, "snapshot_id", "full_outer").filter("known IS NULL OR asked IS NULL")
    return both.select("snapshot_id", F.when(F.col("known").isNull(), "no snapshot").otherwise("no action").alias("problem"))


def disclosing(members: DataFrame, selection: DataFrame, removed: DataFrame, cleared: DataFrame) -> DataFrame:
    """Snapshots that still tell what an excision takes: selected content, removed entries, or cleared metadata."""
    marked = members.select("snapshot_id", "entry_id", "cas_id", "metadata")
    by_content = marked.join(selection.select("cas_id").distinct(), "cas_id", "left_semi").select("snapshot_id")
    by_entry = marked.join(removed.select("entry_id").distinct(), "entry_id", "left_semi").select("snapshot_id")
    by_metadata = marked.filter("metadata <> '{}'").join(cleared.select("entry_id").distinct(), "entry_id", "left_semi").select("snapshot_id")
    return by_content.unionByName(by_entry).unionByName(by_metadata).distinct()


def redact(members: DataFrame, removals: DataFrame, cleared: DataFrame) -> DataFrame:
    """Members without the removed entries (snapshot_id, entry_id), metadata of the cleared ones (likewise) emptied."""
    kept = members.join(removals.select("snapshot_id", "entry_id").distinct(), ["snapshot_id", "entry_id"], "left_anti")
    marked = kept.join(cleared.select("snapshot_id", "entry_id").distinct().withColumn("__clear", F.lit(True)), ["snapshot_id", "entry_id"], "left")
    return marked.withColumn("metadata", F.when(F.col("__clear"), "{}").otherwise(F.col("metadata"))).drop("__clear")
