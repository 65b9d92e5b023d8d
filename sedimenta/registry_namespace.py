"""The queries over namespaces: snapshots, excision effects, operations, references; each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import chains, excise, index, operations, snapshots, tree
from sedimenta.registry import ENTRY_JSON, SEL, E, J, query, selection, simple
from sedimenta.sources.tables import entries, journal, table

HEAD = snapshots.header("n1", "plain", 500, "/", {"generation": 1}, schema="snap.v1")
HEAD_SQL = tuple("'" + t.replace(chr(10), "' || chr(10) || '") + "'" for t in HEAD)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with content: a file holds the object of the document with its customer's number, if there is one."""
    objects = journal(spark, sf_dir).select(F.concat(F.lit("c"), F.col("ord")).alias("entry_id"), "cas_id", F.col("size").alias("object_size"))
    rows = entries(spark, sf_dir).join(objects, "entry_id", "left")
    return rows.withColumn("size", F.coalesce("object_size", "size")).withColumn("metadata", F.when(F.col("entry_id").endswith("3"), '{"k":"v"}').otherwise("{}")).drop("object_size")


H = """H AS (SELECT E.entry_id, kind, parent_id, name, coalesce(J.size, E.size) AS size, changed_revision, live, touched_revision, cas_id, CASE WHEN right(E.entry_id, 1) = '3' THEN '{"k":"v"}' ELSE '{}' END AS metadata FROM E LEFT JOIN J ON E.entry_id = 'c' || J.ord)"""
HB = f"{J}, {E}, {H}"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots: of all live entries, of every second, of every fifth."""
    rows = held(spark, sf_dir).filter("live = 1")
    number = F.coalesce(F.regexp_extract("entry_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
    return rows.withColumn("snapshot_id", F.explode(F.array_compact(F.array(F.lit("s1"), F.when(number % 2 == 0, "s2"), F.when(number % 5 == 0, "s3"))))).select("snapshot_id", *tree.ENTRY)


NUM = "coalesce(TRY_CAST(regexp_extract(entry_id, '(\\d+)$', 1) AS BIGINT), 0)"
MB = f"MB AS (SELECT s AS snapshot_id, H.* FROM H JOIN (VALUES ('s1', 1), ('s2', 2), ('s3', 5)) v(s, k) ON {NUM} % k = 0 WHERE live = 1)"


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.closure(held(spark, sf_dir), "n2").select("entry_id")


RM = "RM AS (SELECT entry_id FROM H WHERE entry_id = 'n2' OR parent_id = 'n2')"


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).filter("entry_id LIKE '%3'").select("entry_id")


simple("snapshot_catalog", entries, lambda e: snapshots.capture(e, "s1", 500, HEAD)[1], f"""WITH {E}, M AS (SELECT {HEAD_SQL[0]} || string_agg({ENTRY_JSON}, ',' ORDER BY entry_id) || {HEAD_SQL[1]} AS content FROM E WHERE live = 1)
  SELECT 's1' AS snapshot_id, 'sha256:' || sha256(content) AS cas_id, CAST(strlen(content) AS BIGINT) AS size, CAST(500 AS BIGINT) AS captured_revision, CAST(1 AS INT) AS live FROM M""")


@query("snapshot_decoded", f"WITH {E} SELECT 's1' AS snapshot_id, entry_id, kind, parent_id, name, size, changed_revision FROM E WHERE live = 1")
def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = snapshots.capture(entries(spark, sf_dir), "s1", 500, HEAD)[2]
    return snapshots.decode(parts)[0].select("snapshot_id", "entry_id", "kind", "parent_id", "name", "size", "changed_revision")


@query("snapshot_inspected", f"WITH {HB}, {MB} SELECT snapshot_id, CAST(7 AS BIGINT) AS captured_revision, entry_id, cas_id FROM MB WHERE snapshot_id = 's2'")
def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([("s1", 5, 1), ("s2", 7, 1), ("s3", 9, 0)], "snapshot_id string, captured_revision bigint, live int")
    return snapshots.inspect(snapshots.deleted(catalog, "s1"), members(spark, sf_dir), "s2").select("snapshot_id", "captured_revision", "entry_id", "cas_id")


simple("snapshot_export", lambda s, d: members(s, d).filter("snapshot_id = 's1'"), snapshots.exported, f"""WITH RECURSIVE {HB}, P AS (SELECT entry_id, '' AS path FROM H WHERE parent_id IS NULL UNION ALL SELECT H.entry_id, CASE WHEN P.path = '' THEN H.name ELSE P.path || '/' || H.name END FROM H JOIN P ON H.parent_id = P.entry_id WHERE live = 1)
  SELECT path, kind, cas_id, size FROM P JOIN H USING (entry_id) WHERE parent_id IS NOT NULL""")


@query("snapshot_uncovered", "SELECT * FROM (VALUES ('s2', 'no action'), ('s9', 'no snapshot')) v(snapshot_id, problem)")
def _uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = spark.createDataFrame([("s1",), ("s3",), ("s9",)], "snapshot_id string")
    return snapshots.uncovered(members(spark, sf_dir).select("snapshot_id").distinct(), actions)


@query("snapshot_disclosing", f"WITH {HB}, {SEL}, {MB}, {RM} SELECT DISTINCT snapshot_id FROM MB WHERE snapshot_id <> 's3' AND (cas_id IN (SELECT cas_id FROM SEL) OR entry_id IN (SELECT entry_id FROM RM) OR (entry_id LIKE '%3' AND metadata <> '{{}}'))")
def _disclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.disclosing(members(spark, sf_dir).filter("snapshot_id <> 's3'"), selection(spark, sf_dir), removed(spark, sf_dir), cleared(spark, sf_dir))


@query("snapshot_redacted", f"WITH {HB}, {MB}, {RM} SELECT snapshot_id, entry_id, CASE WHEN entry_id LIKE '%3' AND snapshot_id = 's1' THEN '{{}}' ELSE metadata END AS metadata FROM MB WHERE NOT (snapshot_id = 's1' AND entry_id IN (SELECT entry_id FROM RM))")
def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit("s1").alias("snapshot_id")
    return snapshots.redact(members(spark, sf_dir), removed(spark, sf_dir).select(one, "entry_id"), cleared(spark, sf_dir).select(one, "entry_id")).select("snapshot_id", "entry_id", "metadata")


@query("excise_entry_effects", f"""WITH {HB}, {RM}, A AS (SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM RM) THEN 0 ELSE live END AS live, CASE WHEN entry_id LIKE '%3' THEN '{{}}' ELSE metadata END AS metadata, changed_revision, touched_revision FROM H),
  B AS (SELECT entry_id, live, metadata, CASE WHEN entry_id LIKE '%3' AND live = 1 THEN 2000001 ELSE changed_revision END AS changed_revision, touched_revision FROM A)
  SELECT entry_id, CAST(live AS INT) AS live, metadata, changed_revision, CASE WHEN live = 1 THEN changed_revision WHEN entry_id IN (SELECT entry_id FROM RM) THEN 2000001 ELSE touched_revision END AS touched_revision FROM B""")
def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excise.effects(held(spark, sf_dir), removed(spark, sf_dir), cleared(spark, sf_dir), 2_000_000).select("entry_id", "live", "metadata", "changed_revision", "touched_revision")


OPS = """OP AS (SELECT 'op' || o_orderkey AS operation_id, CASE o_orderkey % 5 WHEN 0 THEN 'staging' WHEN 1 THEN 'prepared' WHEN 2 THEN 'committed' WHEN 3 THEN 'rejected' ELSE 'retired' END AS state,
  CASE WHEN o_orderkey % 5 = 3 THEN '{"code":"E' || (o_orderkey % 3) || '"}' END AS terminal_error, '{"args":{"entry_id":"c' || o_custkey || '"},"kind":"set-metadata"}' AS request, strftime(o_orderdate, '%Y-%m-%d') AS retire_after FROM orders)"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('op', o_orderkey) AS operation_id", "elt(CAST(o_orderkey % 5 + 1 AS INT), 'staging', 'prepared', 'committed', 'rejected', 'retired') AS state", "CASE WHEN o_orderkey % 5 = 3 THEN concat('{\"code\":\"E', o_orderkey % 3, '\"}') END AS terminal_error",
        "concat('{\"args\":{\"entry_id\":\"c', o_custkey, '\"},\"kind\":\"set-metadata\"}') AS request", "date_format(o_orderdate, 'yyyy-MM-dd') AS retire_after", "CAST(NULL AS STRING) AS terminal_result",
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("op"), F.col("l_orderkey") + 3).alias("operation_id")).distinct()


ASK = "ASK AS (SELECT DISTINCT 'op' || (l_orderkey + 3) AS operation_id FROM lineitem)"
STATUS = f"""ST AS (SELECT ASK.operation_id, CASE WHEN OP.state IS NULL THEN 'unknown' WHEN OP.state = 'staging' THEN 'recovery-required' ELSE OP.state END AS state, json_extract_string(terminal_error, '$.code') AS error,
  CASE OP.state WHEN 'staging' THEN 'recover' WHEN 'prepared' THEN 'retry-same' WHEN 'rejected' THEN 'refresh-new-token' ELSE 'none' END AS next_action FROM ASK LEFT JOIN OP USING (operation_id))"""


@query("operation_status", f"WITH {OPS}, {ASK}, {STATUS} SELECT * FROM ST")
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.statuses(asked(spark, sf_dir), ops(spark, sf_dir))


@query("operation_target", f"WITH {OPS}, {ASK}, {STATUS} SELECT ST.*, json_extract_string(request, '$.args.entry_id') AS entry_id FROM ST LEFT JOIN OP USING (operation_id)")
def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.targets(asked(spark, sf_dir), ops(spark, sf_dir))


@query("operations_expired", f"""WITH {OPS}, {ASK} SELECT operation_id, CASE WHEN due THEN 'retired' ELSE state END AS state, CASE WHEN NOT due THEN request END AS request, CASE WHEN NOT due THEN retire_after END AS retire_after
  FROM (SELECT *, operation_id IN (SELECT operation_id FROM ASK) AND state IN ('committed', 'rejected') AND retire_after <= '1997-01-01' AS due FROM OP)""")
def _expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.expired(ops(spark, sf_dir), asked(spark, sf_dir), "1997-01-01").select("operation_id", "state", "request", "retire_after")


@query("excise_image", f"WITH {HB}, {RM}, {OPS} SELECT entry_id AS id, CAST(live AS VARCHAR) AS state, metadata AS rest FROM H WHERE entry_id NOT IN (SELECT entry_id FROM RM) UNION ALL SELECT operation_id, state, CASE WHEN state <> 'retired' THEN request END FROM OP")
def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, left = excise.image(held(spark, sf_dir), ops(spark, sf_dir), removed(spark, sf_dir))
    return kept.select(F.col("entry_id").alias("id"), F.col("live").cast("string").alias("state"), F.col("metadata").alias("rest")).unionByName(left.select(F.col("operation_id").alias("id"), "state", F.col("request").alias("rest")))


@query("excise_catalog", "SELECT * FROM (VALUES ('s1', 'sha256:new', CAST(9 AS BIGINT)), ('s3', 'sha256:c', CAST(3 AS BIGINT))) v(snapshot_id, cas_id, size)")
def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([("s1", "sha256:a", 1), ("s2", "sha256:b", 2), ("s3", "sha256:c", 3)], "snapshot_id string, cas_id string, size bigint")
    return excise.catalog_after(catalog, catalog.filter("snapshot_id = 's2'"), spark.createDataFrame([("s1", "sha256:new", 9)], "snapshot_id string, cas_id string, size bigint"))


@query("excise_dependencies", f"WITH {HB}, {RM} SELECT DISTINCT 'entry' AS owner_kind, entry_id AS owner_id, cas_id, 'content' AS dependency_kind FROM H WHERE cas_id IS NOT NULL AND entry_id NOT IN (SELECT entry_id FROM RM)")
def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excise.rebuilt_dependencies(held(spark, sf_dir), removed(spark, sf_dir))


@query("excise_left_behind", f"WITH {HB}, {SEL}, {MB} SELECT DISTINCT place, id, cas_id FROM (SELECT 'journal' AS place, event_id AS id, cas_id FROM J WHERE ord % 7 = 0 UNION ALL SELECT 'entry', entry_id, cas_id FROM H UNION ALL SELECT 'snapshot', snapshot_id, cas_id FROM MB UNION ALL SELECT 'content', event_id, cas_id FROM J WHERE ord % 11 = 0) WHERE cas_id IN (SELECT cas_id FROM SEL)")
def _left_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    contents = j.filter("ord % 11 = 0").select(F.col("event_id").alias("owner"), F.concat(F.lit("see "), F.col("cas_id"), F.lit(".")).alias("content"))
    return excise.left_behind(selection(spark, sf_dir), j.filter("ord % 7 = 0"), held(spark, sf_dir), members(spark, sf_dir), contents)


@query("excise_commitment", f"WITH {J}, {SEL} SELECT count(*) AS records, count(DISTINCT cas_id) AS objects FROM J WHERE cas_id NOT IN (SELECT cas_id FROM SEL)")
def _commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cutover keeps, before and after it: the same."""
    kept = excise.retained(journal(spark, sf_dir), selection(spark, sf_dir))
    return kept.agg(F.count("*").alias("records"), F.count_distinct("cas_id").alias("objects"))


@query("epoch_chain_errors", """WITH C AS (SELECT 'op' || n_nationkey AS operation_id, CASE WHEN n_nationkey % 7 = 6 THEN 'g1' ELSE 'g' || n_nationkey END AS generation, n_nationkey * 10 AS before, n_nationkey * 10 + CASE WHEN n_nationkey % 11 = 5 THEN 2 ELSE 1 END AS after, CASE WHEN n_nationkey % 13 = 4 THEN 0 ELSE 1 END AS completed,
    'r' || n_nationkey AS predecessor, 'r' || (n_nationkey + CASE WHEN n_nationkey % 9 = 8 THEN 5 ELSE 1 END) AS successor FROM nation),
  L AS (SELECT *, lag(successor) OVER w AS last_root, lead(after) OVER w AS nxt, count(*) OVER (PARTITION BY generation) AS n FROM C WINDOW w AS (ORDER BY after, operation_id))
  SELECT * FROM (SELECT operation_id, concat_ws(',', CASE WHEN after <> before + 1 THEN 'step' END, CASE WHEN after > 200 THEN 'future' END, CASE WHEN n > 1 OR generation = 'g3' THEN 'repeated-generation' END, CASE WHEN last_root <> predecessor THEN 'chain' END, CASE WHEN completed <> 1 AND nxt IS NOT NULL THEN 'incomplete' END) AS errors FROM L) WHERE errors <> ''""")
def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr(
        "concat('op', n_nationkey) AS operation_id", "CASE WHEN n_nationkey % 7 = 6 THEN 'g1' ELSE concat('g', n_nationkey) END AS generation", "n_nationkey * 10L AS before", "n_nationkey * 10L + CASE WHEN n_nationkey % 11 = 5 THEN 2 ELSE 1 END AS after",
        "CASE WHEN n_nationkey % 13 = 4 THEN 0 ELSE 1 END AS completed", "concat('r', n_nationkey) AS predecessor", "concat('r', n_nationkey + CASE WHEN n_nationkey % 9 = 8 THEN 5 ELSE 1 END) AS successor",
    )
    return excise.epoch_errors(rows, 200, "g3")


@query("reference_errors", f"""WITH {HB}, O AS (SELECT cas_id, min(size) AS size FROM J WHERE ord % 3 > 0 GROUP BY 1), D AS (SELECT 'entry' AS owner_kind, entry_id AS owner_id, cas_id FROM H WHERE cas_id IS NOT NULL AND length(entry_id) % 2 = 1 UNION SELECT 'operation', 'gone', min(cas_id) FROM H)
  SELECT 'entry' AS kind, entry_id AS id, H.cas_id, CASE WHEN O.size IS NULL THEN 'content-missing' ELSE 'content-size' END AS error FROM H LEFT JOIN O USING (cas_id) WHERE cas_id IS NOT NULL AND live = 1 AND (O.size IS NULL OR O.size <> H.size)
  UNION ALL SELECT owner_kind, owner_id, cas_id, 'owner-missing' FROM D WHERE owner_id = 'gone'
  UNION ALL SELECT 'entry', entry_id, cas_id, 'dependency-missing' FROM H WHERE cas_id IS NOT NULL AND live = 1 AND length(entry_id) % 2 = 0""")
def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, j = held(spark, sf_dir), journal(spark, sf_dir)
    own = rows.filter("cas_id IS NOT NULL AND length(entry_id) % 2 = 1").select(F.lit("entry").alias("owner_kind"), F.col("entry_id").alias("owner_id"), "cas_id")
    gone = rows.agg(F.min("cas_id").alias("cas_id")).select(F.lit("operation").alias("owner_kind"), F.lit("gone").alias("owner_id"), "cas_id")
    none = spark.createDataFrame([], "operation_id string, snapshot_id string")
    return operations.reference_errors(rows, index.objects(j.filter("ord % 3 > 0")), own.unionByName(gone), none, none)


@query("reserved_twice", "WITH A AS (SELECT 'x' || o_custkey AS id, 'orders' AS place FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'x' || c_custkey, 'customers' FROM customer WHERE c_custkey % 4 = 0) SELECT id, count(*) AS times, string_agg(DISTINCT place, ',' ORDER BY place) AS places FROM A GROUP BY id HAVING count(*) > 1")
def _reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("x"), F.col("o_custkey")).alias("id")).distinct()
    return operations.reserved_twice(orders=a, customers=table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("x"), F.col("c_custkey")).alias("id")))


@query("declared_conflicts", "SELECT CAST(l_orderkey AS VARCHAR) AS operation_id, CAST(l_suppkey AS VARCHAR) AS cas_id, count(DISTINCT l_quantity) AS sizes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.declared_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("operation_id"), F.col("l_suppkey").cast("string").alias("cas_id"), F.col("l_quantity").alias("size")))


@query("namespace_errors", f"WITH {E} SELECT entry_id AS id, 'parent' AS error FROM E WHERE parent_id = 'n3' AND live = 1 UNION ALL SELECT entry_id, 'unreachable' FROM E WHERE parent_id = 'n3' AND live = 1 UNION ALL SELECT entry_id, 'future' FROM E WHERE touched_revision > 1000000 UNION ALL SELECT NULL, 'totals'")
def _namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = entries(spark, sf_dir).withColumn("live", F.when(F.col("entry_id") == "n3", 0).otherwise(F.col("live")))
    return operations.namespace_errors(odd, {"live_entries": 0}, 1_000_000)


@query("changed_totals", f"WITH {E} SELECT count(*) AS live_entries, CAST(sum(strlen({ENTRY_JSON})) AS BIGINT) AS entry_bytes, count(*) FILTER (WHERE kind = 'file') AS live_files FROM E WHERE live = 1 AND parent_id IS DISTINCT FROM 'n2'")
def _changed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    before = rows.filter("parent_id = 'n2'")
    return operations.changed_totals(tree.totals(rows), before, before.withColumn("live", F.lit(0)))


@query("excision_inventory", f"WITH {HB}, {OPS} SELECT 'entries' AS part, count(*) AS n, min(entry_id) AS least FROM H UNION ALL SELECT 'operations', count(*), min(operation_id) FROM OP UNION ALL SELECT 'contents', count(DISTINCT cas_id), min(cas_id) FROM J")
def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "snapshot_id string, owner_kind string, owner_id string, cas_id string")
    parts = operations.inventory(held(spark, sf_dir), none, ops(spark, sf_dir), none, journal(spark, sf_dir))
    keys = {"entries": "entry_id", "operations": "operation_id", "contents": "cas_id"}
    out = None
    for part, key in keys.items():
        row = parts[part].agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.min(key).alias("least"))
        out = row if out is None else out.unionByName(row)
    return out


# logs, governance
@query("change_families", """WITH P AS (SELECT DISTINCT lang || '/' || CAST(doc_id % 37 AS VARCHAR) || '.txt' AS path FROM documents), M AS (SELECT path, 'english' AS family FROM P WHERE path GLOB 'en/*' UNION ALL SELECT path, 'threes' FROM P WHERE path GLOB '*/3*.txt' UNION ALL SELECT path, 'french' FROM P WHERE path GLOB 'fr/*')
  SELECT path, coalesce(string_agg(family, ',' ORDER BY family), '') AS families, coalesce(count(family), 0) <> 1 AS widens FROM P LEFT JOIN M USING (path) GROUP BY path""")
def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.concat(F.col("lang"), F.lit("/"), (F.col("doc_id") % 37).cast("string"), F.lit(".txt")).alias("path")).distinct()
    return chains.families_of(paths, {"english": ["en/*"], "threes": ["*/3*.txt"], "french": ["fr/*"]}).withColumn("families", F.array_join("families", ","))


@query("timing_report", "WITH M AS (SELECT p_partkey AS proof, p_retailprice AS seconds FROM part WHERE p_partkey % 10 > 0), C AS (SELECT p_partkey AS proof FROM part WHERE p_partkey % 9 > 0) SELECT proof, 'unmeasured' AS kind, CAST(NULL AS DOUBLE) AS seconds FROM C WHERE proof NOT IN (SELECT proof FROM M) UNION ALL SELECT proof, 'gone', seconds FROM M WHERE proof NOT IN (SELECT proof FROM C) UNION ALL (SELECT proof, 'slowest', seconds FROM M WHERE proof IN (SELECT proof FROM C) ORDER BY seconds DESC, proof LIMIT 5)")
def _timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("proof"), F.col("p_retailprice").alias("seconds"))
    return chains.timings(part.filter("proof % 10 > 0"), part.filter("proof % 9 > 0").select("proof"))


@query("chronology_corrected", "WITH B AS (SELECT o_orderkey AS ord, md5(CAST(o_orderkey AS VARCHAR)) AS hash, epoch_us(o_orderdate) AS at, CASE WHEN o_orderkey % 50 = 7 THEN md5(CAST(o_orderkey - 1 AS VARCHAR)) WHEN o_orderkey % 50 = 9 THEN 'none' END AS corrects FROM orders), K AS (SELECT a.ord AS fix, b.ord, a.at FROM B a JOIN B b ON b.hash = a.corrects AND b.ord < a.ord) SELECT B.ord, coalesce(max(K.at), B.at) AS at, false AS bad FROM B LEFT JOIN K ON K.ord = B.ord AND K.at > B.at GROUP BY B.ord, B.at UNION ALL SELECT ord, at, true FROM B WHERE corrects IS NOT NULL AND ord NOT IN (SELECT fix FROM K)")
def _chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ord", "md5(CAST(o_orderkey AS STRING)) AS hash", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ)) AS at", "CASE WHEN o_orderkey % 50 = 7 THEN md5(CAST(o_orderkey - 1 AS STRING)) WHEN o_orderkey % 50 = 9 THEN 'none' END AS corrects")
    good, bad = chains.corrected(rows)
    return good.select("ord", "at", F.lit(False).alias("bad")).unionByName(bad.select("ord", "at", F.lit(True).alias("bad")))
