"""Excision: what goes, what that would take along, and what must not stay anywhere."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.lineage import cut
from sedimenta.operators.tree import closure

LITERAL = "sha256:[0-9a-f]{64}"


def retained(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """rows (journal, objects or remotes) without the selected cas_ids; a bag stays a bag."""
    return rows.join(selection.select("cas_id").distinct(), "cas_id", "left_anti")


def literal_references(contents: DataFrame) -> DataFrame:
    """owner, content: each identifier written in the content, as (owner, cas_id)."""
    return contents.select("owner", F.explode(F.regexp_extract_all("content", F.lit(LITERAL), F.lit(0))).alias("cas_id")).distinct()


def shared_owners(owners: DataFrame, selection: DataFrame, removed: DataFrame) -> DataFrame:
    """owners: owner_id, cas_id. Owners of selected content that are not removed themselves."""
    return owners.join(selection.select("cas_id").distinct(), "cas_id", "left_semi").join(removed.select("owner_id").distinct(), "owner_id", "left_anti")


def dependency_edges(entries: DataFrame, operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, cas_id) of all three kinds of owners, each once."""
    kinds = {"entry": entries, "operation": operations, "snapshot": snapshots}
    out = None
    for kind, df in kinds.items():
        rows = df.filter("cas_id IS NOT NULL").select(F.lit(kind).alias("owner_kind"), "owner_id", "cas_id")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def metadata_matches(rows: DataFrame, column: str, forbidden: list[str]) -> DataFrame:
    """Rows whose field, or a component of it between slashes, is forbidden."""
    return rows.filter(F.col(column).isin(forbidden) | F.arrays_overlap(F.split(column, "/"), F.array(*map(F.lit, forbidden))))


def disclosures(selection: DataFrame, edges: DataFrame) -> DataFrame:
    """The least set with the selection that holds every owner of what it holds. edges: owner, cas_id, where an owner
    discloses the content and is content itself. Each round adds owners of the last round's additions only, until there
    are none; it is cut off from the plan before it by a checkpoint in the session's shared folder."""
    found = selection.select("cas_id").distinct()
    new = found
    while True:
        owners = edges.join(new, "cas_id", "left_semi").select(F.col("owner").alias("cas_id")).distinct()
        new = cut(owners.join(found, "cas_id", "left_anti"))
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new))

def plan(entries: DataFrame, root: str, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that go, conflicts): live entries elsewhere that still hold selected content."""
    going = closure(entries, root).select("entry_id")
    holders = entries.filter("live = 1").join(selection.select("cas_id").distinct(), "cas_id", "left_semi")
    return going, holders.join(going, "entry_id", "left_anti").select("entry_id", "cas_id")


def redacted(manifest: DataFrame, selection: DataFrame) -> DataFrame:
    """Snapshot manifests (snapshot_id, entries: array of structs with cas_id) without selected members."""
    rows = manifest.select("snapshot_id", F.posexplode_outer("entries").alias("pos", "entry"))
    kept = rows.join(selection.select("cas_id").distinct().withColumn("gone", F.lit(True)), F.col("entry.cas_id") == F.col("cas_id"), "left")
    return kept.groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull() & F.col("entry").isNotNull(), F.struct("pos", "entry")))), lambda x: x["entry"]).alias("entries"), F.count_if("gone").alias("removed"))


def successor(identity: dict, store_id: str, epoch_id: str) -> dict:
    """The identity after an excision: the same lineage, a new epoch, one generation more."""
    return identity | {"store_id": store_id, "epoch_id": epoch_id, "generation": identity["generation"] + 1, "predecessor_epoch_id": identity["epoch_id"]}


def effects(entries: DataFrame, removed: DataFrame, cleared: DataFrame, revision: int) -> DataFrame:
    """entries after the cutover: removed ones dead and touched at revision + 1, cleared metadata empty; a cleared entry that
    still lives is changed at revision + 1, and every live entry is touched when it was changed."""
    marked = entries.join(removed.select("entry_id").distinct().withColumn("__gone", F.lit(True)), "entry_id", "left")
    marked = marked.join(cleared.select("entry_id").distinct().withColumn("__clear", F.lit(True)), "entry_id", "left")
    after = F.lit(revision + 1).cast("bigint")
    live = F.when(F.col("__gone"), 0).otherwise(F.col("live"))
    rows = marked.withColumn("live", live).withColumn("metadata", F.when(F.col("__clear"), "{}").otherwise(F.col("metadata")))
    rows = rows.withColumn("changed_revision", F.when(F.col("__clear") & (F.col("live") == 1), after).otherwise(F.col("changed_revision")))
    touched = F.when(F.col("live") == 1, F.col("changed_revision")).when(F.col("__gone"), after).otherwise(F.col("touched_revision"))
    return rows.withColumn("touched_revision", touched).drop("__gone", "__clear")


def image(entries: DataFrame, operations: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, operations) of the fresh database: removed entries are no rows at all, retired operations have only their id and state."""
    kept = entries.join(removed.select("entry_id").distinct(), "entry_id", "left_anti")
    retired = F.col("state") == "retired"
    blank = [F.when(~retired, F.col(c)).alias(c) for c in operations.columns if c not in ("operation_id", "state")]
    return kept, operations.select("operation_id", "state", *blank)


def catalog_after(catalog: DataFrame, dropped: DataFrame, republished: DataFrame) -> DataFrame:
    """The snapshot catalog without dropped ones, redacted ones (snapshot_id, cas_id, size) pointing to their new content."""
    kept = catalog.join(dropped.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    new = republished.select("snapshot_id", F.col("cas_id").alias("__cas"), F.col("size").alias("__size"))
    return kept.join(new, "snapshot_id", "left").withColumn("cas_id", F.coalesce("__cas", "cas_id")).withColumn("size", F.coalesce("__size", "size")).drop("__cas", "__size")


def rebuilt_dependencies(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """The content that entries hold, deleted entries too, without the removed: the dependencies after a cutover."""
    held = entries.filter("cas_id IS NOT NULL").join(removed.select("entry_id").distinct(), "entry_id", "left_anti")
    return held.select(F.lit("entry").alias("owner_kind"), F.col("entry_id").alias("owner_id"), "cas_id", F.lit("content").alias("dependency_kind")).distinct()


def completion(operation_id: str, generation: str, before: int, predecessor: str, successor_root: str) -> dict:
    """The row of the epoch table that a completed cutover appends."""
    return {"operation_id": operation_id, "generation": generation, "before": before, "after": before + 1, "completed": 1, "predecessor": predecessor, "successor": successor_root}


def left_behind(selection: DataFrame, journal: DataFrame, entries: DataFrame, members: DataFrame, contents: DataFrame) -> DataFrame:
    """The scan after a cutover: (place, id, cas_id) wherever something selected is still found; nothing should be."""
    chosen = selection.select("cas_id").distinct()
    out = journal.join(chosen, "cas_id", "left_semi").select(F.lit("journal").alias("place"), F.col("event_id").alias("id"), "cas_id")
    for place, rows in (("entry", entries.select(F.col("entry_id").alias("id"), "cas_id")), ("snapshot", members.select(F.col("snapshot_id").alias("id"), "cas_id")), ("content", literal_references(contents).select(F.col("owner").alias("id"), "cas_id"))):
        out = out.unionByName(rows.join(chosen, "cas_id", "left_semi").select(F.lit(place).alias("place"), "id", "cas_id"))
    return out.distinct()


def epoch_errors(completions: DataFrame, current_revision: int, initial_generation: str) -> DataFrame:
    """Rows of the epoch table that break its chain: operation, generation, before, after, completed, predecessor, successor.

    One row per excision, so the chain itself is short; its order is by (after, operation).
    """
    order = Window.orderBy("after", "operation_id")
    rows = completions.withColumn("__last_after", F.coalesce(F.lag("after").over(order), F.lit(0))).withColumn("__last_root", F.lag("successor").over(order)).withColumn("__next", F.lead("after").over(order))
    for column in ("operation_id", "generation"):
        rows = rows.withColumn(f"__n_{column}", F.count("*").over(Window.partitionBy(column)))
    crossed = rows.join(completions.select(F.col("operation_id").alias("generation"), F.lit(True).alias("__crossed")).distinct(), "generation", "left")
    rules = {
        "step": F.col("after") != F.col("before") + 1,
        "order": F.col("before") < F.col("__last_after"),
        "future": F.col("after") > current_revision,
        "repeated-operation": F.col("__n_operation_id") > 1,
        "repeated-generation": (F.col("__n_generation") > 1) | (F.col("generation") == initial_generation) | F.coalesce("__crossed", F.lit(False)),
        "chain": F.col("__last_root").isNotNull() & (F.col("predecessor") != F.col("__last_root")),
        "incomplete": (F.col("completed") != 1) & F.col("__next").isNotNull(),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return crossed.select("operation_id", F.array_join(found, ",").alias("errors")).filter("errors <> ''")
