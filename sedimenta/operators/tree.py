"""The tree: closures, depths, paths, whole-tree checks, and its mutations as a log."""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_bytes_udf, comparison_key, comparison_key_udf, normal_form_udf
from sedimenta.operators.lineage import cut, shared_dir
from sedimenta.schemas import MOST_ENTRIES, NAME_BYTES

ENTRY = ("entry_id", "kind", "parent_id", "name", "metadata", "cas_id", "size", "changed_revision")



def with_key(entries: DataFrame) -> DataFrame:
    """entries with the key by which names are compared, computed where it is not stored."""
    return entries if "comparison_key" in entries.columns else entries.withColumn("comparison_key", comparison_key_udf("name"))


def ascents(edges: DataFrame) -> DataFrame:
    """edges: entry_id, up (NULL at a top), path (the entry's part of it). Every entry that reaches a top: entry_id, top, hops, path.

    Pointer doubling: in each round an entry takes over where its pointer's pointer leads, so n levels take log2(n)
    rounds. Between a top and an entry still on its way there is always one that arrives in the next round; a round in
    which none does leaves only cycles and entries whose way leads nowhere, and ends it.
    """
    top = F.col("up").isNull()
    state = cut(edges.select("entry_id", "up", F.when(top, F.col("entry_id")).alias("top"), F.when(top, 0).otherwise(1).cast("bigint").alias("hops"), "path"))
    waiting = state.filter("up IS NOT NULL").count()
    while waiting:
        there = state.select(F.col("entry_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("hops").alias("hops2"), F.col("path").alias("path2"))
        moved = state.filter("up IS NOT NULL").join(there, "up").select("entry_id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("hops") + F.col("hops2")).alias("hops"), F.concat("path2", "path").alias("path"))
        state = cut(state.filter("up IS NULL").unionByName(moved))
        before, waiting = waiting, state.filter("up IS NOT NULL").count()
        if waiting == before:
            break
    return state.filter("up IS NULL").drop("up")


def closure(entries: DataFrame, root: str, live_only: bool = False) -> DataFrame:
    """root and all below it with their level; only directories are gone through."""
    rows = entries.filter("live = 1") if live_only else entries
    directories = rows.filter("kind = 'directory'").select(F.col("entry_id").alias("parent_id"))
    edges = rows.filter(F.col("entry_id") == root).select("entry_id", F.lit(None).cast("string").alias("up"), F.lit("").alias("path"))
    edges = edges.unionByName(rows.filter(F.col("entry_id") != root).join(directories, "parent_id", "left_semi").select("entry_id", F.col("parent_id").alias("up"), F.lit("").alias("path")))
    below = ascents(edges).filter(F.col("top") == root).select("entry_id", F.col("hops").alias("level"))
    return rows.select("entry_id", "kind").join(below, "entry_id")


def paths(entries: DataFrame) -> DataFrame:
    """Every entry reachable from a root (no parent), with its depth and path."""
    edges = entries.select("entry_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), "name")).alias("path"))
    return ascents(edges).select("entry_id", F.col("hops").alias("depth"), "path")


def ancestors(entries: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """The upward chains of entry_ids (entry_id): entry_id, ancestor_id, level (0 is the entry itself). A chain that repeats an entry ends there."""
    up = entries.select(F.col("entry_id").alias("ancestor_id"), "parent_id")
    new = cut(entry_ids.select("entry_id").distinct().select("entry_id", F.col("entry_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("level")))
    found = new
    while not new.isEmpty():
        higher = new.join(up, "ancestor_id").filter("parent_id IS NOT NULL").select("entry_id", F.col("parent_id").alias("ancestor_id"), (F.col("level") + 1).alias("level"))
        new = cut(higher.join(found, ["entry_id", "ancestor_id"], "left_anti"))
        found = cut(found.unionByName(new))
    return found


def resolve(entries: DataFrame, components: list[str]) -> DataFrame:
    """The live entry at a path, a component at a time, compared by key; no row if there is none."""
    keyed = with_key(entries.filter("live = 1"))
    at = keyed.filter("parent_id IS NULL").select("entry_id")
    for name in components:
        child = keyed.filter(F.col("comparison_key") == comparison_key(name)).select(F.col("entry_id").alias("child"), "parent_id")
        at = at.join(child, at.entry_id == child.parent_id).select(F.col("child").alias("entry_id"))
    return at


def orphans(entries: DataFrame) -> DataFrame:
    """Live entries that no path from the root reaches: their parent is missing or they lie on a cycle."""
    live = entries.filter("live = 1")
    return live.select("entry_id", "parent_id").join(paths(live).select("entry_id"), "entry_id", "left_anti")


def bad_parents(entries: DataFrame) -> DataFrame:
    """Live entries whose parent is no live directory."""
    parents = entries.filter("live = 1 AND kind = 'directory'").select(F.col("entry_id").alias("parent_id"))
    return entries.filter("live = 1 AND parent_id IS NOT NULL").join(parents, "parent_id", "left_anti").select("entry_id", "parent_id")


def sibling_conflicts(entries: DataFrame) -> DataFrame:
    """Live siblings whose names compare equal."""
    keyed = with_key(entries.filter("live = 1 AND parent_id IS NOT NULL"))
    return keyed.groupBy("parent_id", "comparison_key").agg(F.count("*").alias("n")).filter("n > 1")


def entry_json() -> Column:
    """An entry as JSON with all its fields; metadata (a JSON text) is put in as what it says."""
    fields = [f for f in ENTRY if f != "metadata"]
    plain = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"metadata":'), F.coalesce(F.col("metadata"), F.lit("{}")), F.lit(","), F.substr(plain, F.lit(2)))


def with_bytes(entries: DataFrame) -> DataFrame:
    """entries with entry_bytes: the length of the canonical form, without its line feed."""
    whole = entries if "metadata" in entries.columns else entries.withColumn("metadata", F.lit("{}"))
    if "cas_id" not in whole.columns:
        whole = whole.withColumn("cas_id", F.lit(None).cast("string"))
    return whole.withColumn("entry_bytes", (F.octet_length(canonical_bytes_udf(entry_json())) - 1).cast("bigint"))


def totals(entries: DataFrame) -> DataFrame:
    """One row: live entries, the sum of their canonical lengths, live files."""
    live = with_bytes(entries.filter("live = 1"))
    return live.agg(F.count("*").alias("live_entries"), F.coalesce(F.sum("entry_bytes"), F.lit(0)).alias("entry_bytes"), F.count_if(F.col("kind") == "file").alias("live_files"))


def over_capacity(entries: DataFrame, most: int = MOST_ENTRIES) -> bool:
    return entries.filter("live = 1").limit(most + 1).count() > most


def entry_errors(entries: DataFrame) -> DataFrame:
    """entry_id, errors: what is wrong with each entry by itself; entries without errors are left out."""
    name = F.col("name")
    rules = {
        "kind": ~F.col("kind").isin("file", "directory"),
        "name-missing": F.col("parent_id").isNotNull() & (name.isNull() | (name == "")),
        "name-length": F.octet_length(name) > NAME_BYTES,
        "name-characters": name.rlike(r"[/\\\x00-\x1f\x7f-\x{9f}]"),
        "name-form": name != normal_form_udf(name),
        "name-reserved": name.isin(".", ".."),
        "content": (F.col("kind") == "file") != F.col("size").isNotNull(),
        "live": ~F.col("live").isin(0, 1),
    }
    errors = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())))
    return entries.select("entry_id", errors.alias("errors")).filter(F.size("errors") > 0)


def state_at(log: DataFrame, revision: int) -> DataFrame:
    """The entries in force at a revision, from a log with a row for each entry that a revision changed."""
    latest = log.filter(F.col("revision") <= revision).groupBy("entry_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "entry_id")), "revision").alias("e"))
    return latest.select("entry_id", "e.*")


def creation_log(entries: DataFrame) -> DataFrame:
    """The log that leads to `entries`: each is created live, and those deleted get a second row."""
    created = entries.selectExpr("entry_id", "changed_revision AS revision", "kind", "parent_id", "name", "1 AS live")
    deleted = entries.filter("live = 0").selectExpr("entry_id", "touched_revision AS revision", "kind", "parent_id", "name", "0 AS live")
    return created.unionByName(deleted)


class Refusal(ValueError):
    """A mutation that the tree's rules refuse; its code is the message's first word."""


class MutationLog:
    """A tree as an immutable log in a folder: each accepted request appends the rows it changes at revision + 1.

    Requests carry a token; the same token and arguments replay the saved result, other arguments are refused. Log and
    results are Parquet tables in `path`, so they outlive the session; a request reads the rows of the entries that it
    names, and only requests on subtrees read the tree. One writer at a time.
    """

    COLUMNS = ("entry_id", "kind", "parent_id", "name", "metadata", "cas_id", "size", "live")
    LOG = "entry_id string, kind string, parent_id string, name string, metadata string, cas_id string, size bigint, live int, revision bigint, comparison_key string"
    RESULTS = "token string, request string, revision bigint"

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/sedimenta/tree-{uuid.uuid4().hex}"
        if not self._exists("log"):
            root = spark.range(1).selectExpr("'/' AS entry_id", "'directory' AS kind", "CAST(NULL AS STRING) AS parent_id", "CAST(NULL AS STRING) AS name", "'{}' AS metadata", "CAST(NULL AS STRING) AS cas_id", "CAST(NULL AS BIGINT) AS size", "1 AS live", "0L AS revision")
            self._write(root if rows is None else rows)
        self.revision = self.log.agg(F.max("revision")).first()[0] or 0

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, rows: DataFrame) -> None:
        rows = rows.drop("comparison_key").withColumn("comparison_key", comparison_key_udf("name"))
        kinds = [f.split() for f in self.LOG.split(", ")]
        rows.select(*(F.col(c).cast(kind) for c, kind in kinds)).write.mode("append").parquet(f"{self.path}/log")

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")

    def _result(self, token: str) -> tuple[str, int] | None:
        if not self._exists("results"):
            return None
        row = self.spark.read.schema(self.RESULTS).parquet(f"{self.path}/results").filter(F.col("token") == token).first()
        return (row["request"], row["revision"]) if row else None

    def state(self, revision: int | None = None) -> DataFrame:
        return state_at(self.log, self.revision if revision is None else revision)

    def _now(self, entries: Column) -> DataFrame:
        """The entries in force among those with a row in the log that satisfies the condition."""
        ids = self.log.filter(entries).select("entry_id").distinct()
        return state_at(self.log.join(ids, "entry_id", "left_semi"), self.revision)

    def _one(self, entry_id: str) -> dict:
        row = self._now(F.col("entry_id") == entry_id).filter("live = 1").first()
        if row is None:
            raise Refusal(f"entry-missing {entry_id}")
        return row.asDict()

    def _free(self, parent: str, name: str, but: str | None = None) -> None:
        if self._one(parent)["kind"] != "directory":
            raise Refusal(f"parent-not-directory {parent}")
        here = (F.col("parent_id") == parent) & (F.col("comparison_key") == comparison_key(name))
        if not self._now(here).filter(here & (F.col("live") == 1) & (F.col("entry_id") != (but or ""))).isEmpty():
            raise Refusal(f"name-taken {name}")

    def _append(self, rows: DataFrame) -> int:
        self._write(rows.select(*self.COLUMNS).withColumn("revision", F.lit(self.revision + 1).cast("bigint")))
        self.revision += 1
        return self.revision

    def _row(self, **values: object) -> DataFrame:
        kinds = dict.fromkeys(self.COLUMNS, "string") | {"size": "bigint", "live": "int"}
        return self.spark.range(1).select(*(F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in self.COLUMNS))

    def execute(self, token: str, kind: str, expected_revision: int | None = None, **args: object) -> int:
        """The revision that the request led to."""
        request = json.dumps([kind, args], sort_keys=True)
        if saved := self._result(token):
            if saved[0] != request:
                raise Refusal(f"operation-conflict {token}")
            return saved[1]
        if expected_revision is not None and expected_revision != self.revision:
            raise Refusal(f"revision-conflict {expected_revision} is not {self.revision}")
        revision = getattr(self, f"_{kind.replace('-', '_')}")(**args)
        self.spark.createDataFrame([(token, request, revision)], self.RESULTS).write.mode("append").parquet(f"{self.path}/results")
        return revision

    def _create_directory(self, entry_id: str, parent_id: str, name: str, metadata: str = "{}") -> int:
        return self._create(entry_id, parent_id, name, metadata, "directory")

    def _create_file(self, entry_id: str, parent_id: str, name: str, cas_id: str, size: int, metadata: str = "{}") -> int:
        return self._create(entry_id, parent_id, name, metadata, "file", cas_id, size)

    def _create(self, entry_id: str, parent_id: str, name: str, metadata: str, kind: str, cas_id: str | None = None, size: int | None = None) -> int:
        if not self.log.filter(F.col("entry_id") == entry_id).isEmpty():
            raise Refusal(f"entry-exists {entry_id}")
        self._free(parent_id, name)
        return self._append(self._row(entry_id=entry_id, kind=kind, parent_id=parent_id, name=name, metadata=metadata, cas_id=cas_id, size=size, live=1))

    def _replace_content(self, entry_id: str, cas_id: str, size: int) -> int:
        row = self._one(entry_id)
        if row["kind"] != "file":
            raise Refusal(f"not-a-file {entry_id}")
        return self._append(self._row(**row | {"cas_id": cas_id, "size": size}))

    def _relocate(self, entry_id: str, parent_id: str, name: str) -> int:
        row = self._one(entry_id)
        if not closure(self.state(), entry_id, live_only=True).filter(F.col("entry_id") == parent_id).isEmpty():
            raise Refusal(f"inside-itself {entry_id}")
        self._free(parent_id, name, entry_id)
        return self._append(self._row(**row | {"parent_id": parent_id, "name": name}))

    def _set_metadata(self, entry_id: str, metadata: str) -> int:
        return self._append(self._row(**self._one(entry_id) | {"metadata": metadata}))

    def _delete_entry(self, entry_id: str) -> int:
        row = self._one(entry_id)
        below = F.col("parent_id") == entry_id
        if not self._now(below).filter(below & (F.col("live") == 1)).isEmpty():
            raise Refusal(f"not-empty {entry_id}")
        return self._append(self._row(**row | {"live": 0}))

    def _delete_subtree(self, entry_id: str) -> int:
        self._one(entry_id)
        now = self.state()
        gone = now.join(closure(now, entry_id, live_only=True).select("entry_id"), "entry_id", "left_semi")
        return self._append(gone.withColumn("live", F.lit(0)))

    def _duplicate(self, entry_id: str, parent_id: str, name: str, ids: dict[str, str]) -> int:
        """Copies a subtree; ids must name a fresh id for exactly its entries."""
        now = self.state()
        own = now.join(closure(now, entry_id, live_only=True).select("entry_id"), "entry_id", "left_semi")
        mapping = self.spark.createDataFrame([*ids.items()], "old string, new string")
        if own.count() != len(ids) or not own.join(mapping, own.entry_id == mapping.old, "left_anti").isEmpty():
            raise Refusal(f"mapping {entry_id}")
        if not self.log.join(mapping, F.col("entry_id") == F.col("new"), "left_semi").isEmpty():
            raise Refusal("entry-exists in mapping")
        self._free(parent_id, name)
        parents = mapping.toDF("old_parent", "new_parent")
        copied = own.join(mapping, own.entry_id == mapping.old).join(parents, F.col("parent_id") == F.col("old_parent"), "left")
        top = F.col("old") == entry_id
        return self._append(copied.select(F.col("new").alias("entry_id"), "kind", F.when(top, F.lit(parent_id)).otherwise(F.col("new_parent")).alias("parent_id"), F.when(top, F.lit(name)).otherwise(F.col("name")).alias("name"), "metadata", "cas_id", "size", "live"))

    def _import_folder(self, rows: tuple[tuple[object, ...], ...]) -> int:
        """Rows (entry_id, kind, parent_id, name, metadata, cas_id, size), inserted together or not at all."""
        incoming = self.spark.createDataFrame([(*r, 1) for r in rows], "entry_id string, kind string, parent_id string, name string, metadata string, cas_id string, size bigint, live int")
        both = self.state().drop("revision", "comparison_key").unionByName(incoming)
        if both.groupBy("entry_id").count().filter("count > 1").count():
            raise Refusal("entry-exists in import")
        for check, code in ((bad_parents, "parent-not-directory"), (sibling_conflicts, "name-taken"), (orphans, "unreachable"), (entry_errors, "entry-invalid")):
            if not check(both).isEmpty():
                raise Refusal(f"{code} in import")
        return self._append(incoming)
