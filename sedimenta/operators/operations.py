"""Operations on a namespace: their status, expiry and requests; reservations, references and the facts that probes read.

operations: operation_id, state, fingerprint, request (JSON), terminal_result, terminal_error (JSON), retire_after.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_bytes
from sedimenta.operators import tree

STATES = ("prepared", "committed", "rejected", "retired", "recovery-required")
#: Lists of a request that are sets: sorted, and refused with repeats.
SETS = ("identities", "operation_ids", "content_ids", "entry_ids")
#: Rows of declarations that a task groups.
ROWS = 500_000


def state_of() -> Column:
    return F.when(F.col("state") == "staging", "recovery-required").otherwise(F.col("state"))


def statuses(asked: DataFrame, operations: DataFrame) -> DataFrame:
    """asked: operation_id. Each with state (unknown if there is no such operation), error code, and what to do next."""
    rows = asked.select("operation_id").join(operations, "operation_id", "left").withColumn("state", F.coalesce(state_of(), F.lit("unknown")))
    action = F.when(F.col("state") == "recovery-required", "recover").when(F.col("state") == "prepared", "retry-same").when(F.col("state") == "rejected", "refresh-new-token").otherwise("none")
    return rows.select("operation_id", "state", F.get_json_object("terminal_error", "$.code").alias("error"), action.alias("next_action"))


def targets(asked: DataFrame, operations: DataFrame) -> DataFrame:
    """Status, and the entry that the stored request is about."""
    primary = operations.select("operation_id", F.coalesce(F.get_json_object("request", "$.args.entry_id"), F.get_json_object("request", "$.args.root_entry_id")).alias("entry_id"))
    return statuses(asked, operations).join(primary, "operation_id", "left")


def expired(operations: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """operations with the asked terminal ones past retire_after blanked to their id and the state retired."""
    due = F.col("__asked") & F.col("state").isin("committed", "rejected") & (F.col("retire_after") <= now)
    rows = operations.join(asked.select("operation_id", F.lit(True).alias("__asked")).distinct(), "operation_id", "left").withColumn("__due", F.coalesce(due, F.lit(False)))
    blank = [F.when(~F.col("__due"), F.col(c)).alias(c) for c in operations.columns if c not in ("operation_id", "state")]
    return rows.select("operation_id", F.when(F.col("__due"), "retired").otherwise(F.col("state")).alias("state"), *blank)


def normalised(request: dict) -> dict:
    """A request with its sets sorted; repeats in them are refused."""
    args = dict(request["args"])
    for name in SETS:
        if name in args:
            if len(set(args[name])) != len(args[name]):
                raise tree.Refusal(f"repeated in {name}")
            args[name] = sorted(args[name])
    return request | {"args": args}


def fingerprint(request: dict, schema: str) -> str:
    """The digest by which equal requests are told: without the token, under the schema of fingerprints."""
    import hashlib

    rest = {k: v for k, v in normalised(request).items() if k != "operation_id"} | {"schema": schema}
    return hashlib.sha256(canonical_bytes(json.dumps(rest))).hexdigest()


def declared_conflicts(declared: DataFrame) -> DataFrame:
    """declared: operation_id, cas_id, size. Content that one request declares with several sizes.

    Nearly every row is a group of its own, so rows are dealt out before they are grouped, into so many parts that each
    has about ROWS of them: maps of all the groups in a file's split would combine nothing and grow with the input.
    """
    parts = 1 + declared.count() // ROWS
    return declared.repartition(parts, "operation_id", "cas_id").groupBy("operation_id", "cas_id").agg(F.count_distinct("size").alias("sizes")).filter("sizes > 1")


def reserved_twice(**tables: DataFrame) -> DataFrame:
    """Ids (column id) that stand in more than one place, or twice in one: id, places."""
    both = None
    for place, rows in sorted(tables.items()):
        rows = rows.select("id", F.lit(place).alias("place"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("id").agg(F.count("*").alias("times"), F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places")).filter("times > 1")


def in_any(ids: DataFrame, *tables: DataFrame) -> bool:
    """Whether any of the ids stands in any table (column id)."""
    both = None
    for rows in tables:
        both = rows.select("id") if both is None else both.unionAll(rows.select("id"))
    return not both.join(ids.select("id"), "id", "left_semi").limit(1).isEmpty()


def reference_errors(entries: DataFrame, objects: DataFrame, dependencies: DataFrame, operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(kind, id, cas_id, error): files whose content is unknown or has another size; dependencies of owners that are not
    there; content that an owner holds without a dependency."""
    sizes = objects.select("cas_id", F.col("size").alias("stored"))
    files = entries.filter("cas_id IS NOT NULL AND live = 1").select("entry_id", "cas_id", "size").join(sizes, "cas_id", "left")
    fault = F.when(F.col("stored").isNull(), "content-missing").when(F.col("stored") != F.col("size"), "content-size")
    out = files.select(F.lit("entry").alias("kind"), F.col("entry_id").alias("id"), "cas_id", fault.alias("error")).filter("error IS NOT NULL")
    owners = entries.select(F.lit("entry").alias("owner_kind"), F.col("entry_id").alias("owner_id")).unionByName(operations.select(F.lit("operation").alias("owner_kind"), F.col("operation_id").alias("owner_id"))).unionByName(snapshots.select(F.lit("snapshot").alias("owner_kind"), F.col("snapshot_id").alias("owner_id")))
    lost = dependencies.join(owners, ["owner_kind", "owner_id"], "left_anti").select(F.col("owner_kind").alias("kind"), F.col("owner_id").alias("id"), "cas_id", F.lit("owner-missing").alias("error"))
    held = entries.filter("cas_id IS NOT NULL AND live = 1").select(F.lit("entry").alias("owner_kind"), F.col("entry_id").alias("owner_id"), "cas_id")
    bare = held.join(dependencies, ["owner_kind", "owner_id", "cas_id"], "left_anti").select(F.col("owner_kind").alias("kind"), F.col("owner_id").alias("id"), "cas_id", F.lit("dependency-missing").alias("error"))
    return out.unionByName(lost).unionByName(bare)


def namespace_errors(entries: DataFrame, totals: dict[str, int], revision: int) -> DataFrame:
    """(id, error) of everything that a whole namespace's rules refuse; id is NULL where the totals differ."""
    out = tree.bad_parents(entries).select(F.col("entry_id").alias("id"), F.lit("parent").alias("error"))
    out = out.unionByName(tree.orphans(entries).select(F.col("entry_id").alias("id"), F.lit("unreachable").alias("error")))
    out = out.unionByName(tree.sibling_conflicts(entries).select(F.concat_ws("/", "parent_id", "comparison_key").alias("id"), F.lit("siblings").alias("error")))
    out = out.unionByName(entries.filter("touched_revision < changed_revision").select(F.col("entry_id").alias("id"), F.lit("touched").alias("error")))
    out = out.unionByName(entries.filter(F.col("touched_revision") > revision).select(F.col("entry_id").alias("id"), F.lit("future").alias("error")))
    differ = F.lit(False)
    for name, value in totals.items():
        differ = differ | (F.col(name) != value)
    return out.unionByName(tree.totals(entries).filter(differ).select(F.lit(None).cast("string").alias("id"), F.lit("totals").alias("error")))


def changed_totals(totals: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals (live_entries, entry_bytes, live_files) kept up by what a request changed: the rows it replaced and their new versions."""
    own = lambda rows, sign: tree.with_bytes(rows.filter("live = 1")).agg(F.count("*").alias("e"), F.coalesce(F.sum("entry_bytes"), F.lit(0)).alias("b"), F.count_if(F.col("kind") == "file").alias("f")).select(*(F.col(c) * sign for c in "ebf")).toDF("e", "b", "f")
    delta = own(before, -1).unionAll(own(after, 1)).agg(F.sum("e").alias("e"), F.sum("b").alias("b"), F.sum("f").alias("f"))
    return totals.crossJoin(delta).select((F.col("live_entries") + F.col("e")).alias("live_entries"), (F.col("entry_bytes") + F.col("b")).alias("entry_bytes"), (F.col("live_files") + F.col("f")).alias("live_files"))  # one row each


def migrated_namespace(entries: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second version of a namespace: entries are touched when they were changed, only entries' dependencies stay."""
    return entries.withColumn("touched_revision", F.col("changed_revision")), dependencies.filter("owner_kind = 'entry'")


def inventory(entries: DataFrame, snapshots: DataFrame, operations: DataFrame, dependencies: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """What an excision may select from, each sorted by id: deleted entries and snapshots too, operations that bear a payload."""
    bearing = operations.filter("request IS NOT NULL OR terminal_result IS NOT NULL").select("operation_id", "state")
    return {"entries": entries.orderBy("entry_id"), "snapshots": snapshots.orderBy("snapshot_id"), "operations": bearing.orderBy("operation_id"), "dependencies": dependencies.orderBy("owner_kind", "owner_id", "cas_id"), "contents": objects.select("cas_id").distinct().orderBy("cas_id")}


def lifecycle(metadata: dict) -> str | None:
    """Why a store may not be used, or None."""
    if not isinstance(metadata.get("state"), str):
        return "invalid"
    if metadata["state"] == "retired":
        return "retired"
    if metadata["state"] != "active":
        return "not-active"
    return None if metadata.get("store_id") else "identity-required"


def admission_errors(revision: int, control_documents: DataFrame) -> str | None:
    """Why a namespace may not be seeded, or None: only a fresh one, and never with control documents."""
    if revision != 0:
        return "revision-conflict"
    return None if control_documents.isEmpty() else "control-document"
