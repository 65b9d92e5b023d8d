"""The queries of the engine's own operators over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.names import canonical_line, canonical_line_udf, path_key_udf  # noqa: F401
from sedimenta.operators import chains, excise, index, intervals, lookup, onboard, tree, validate, verify
from sedimenta.plans import composites
from sedimenta.schemas import DOCX
from sedimenta.sources.tables import chain_events, entries, journal, parks, spans, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

J = f"""J AS (
  SELECT doc_id AS ord, 'uuid:' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) || '-4' || substr(md5(CAST(doc_id AS VARCHAR)), 14, 3)
      || '-8' || substr(md5(CAST(doc_id AS VARCHAR)), 18, 3) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 21, 12) AS event_id,
    strftime(TIMESTAMP '2026-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS at, 'sha256:' || sha256(text) AS cas_id, CAST(strlen(text) AS BIGINT) AS size,
    CASE doc_id % 11 WHEN 0 THEN 'application/zip' WHEN 1 THEN '{DOCX}' ELSE 'text/plain' END AS media_type,
    source AS source_root_id, lang || '/' || CAST(doc_id % 37 AS VARCHAR) || '.txt' AS original_relpath,
    CASE WHEN doc_id % 5 <> 0 THEN 'b' || CAST(doc_id % 4 AS VARCHAR) END AS batch FROM documents)"""
E = """E AS (
  SELECT '/' AS entry_id, 'directory' AS kind, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS size, CAST(0 AS BIGINT) AS changed_revision, 1 AS live, CAST(0 AS BIGINT) AS touched_revision
  UNION ALL SELECT 'r' || r_regionkey, 'directory', '/', r_name, NULL, r_regionkey + 1, 1, r_regionkey + 1 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'directory', 'r' || n_regionkey, n_name, NULL, n_nationkey + 10, 1, n_nationkey + 10 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'file', 'n' || c_nationkey, c_name, strlen(c_name), c_custkey + 100, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END,
    c_custkey + CASE WHEN c_custkey % 17 = 0 THEN 1000000 ELSE 100 END FROM customer)"""
S = """S AS (
  SELECT user_id AS g, event_id AS span_id, event_type AS category, CAST(event_id % 3 AS INT) AS depth, event_id % 4 + 1 AS attempt, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome,
    epoch_us(ts) AS st, epoch_us(ts) + CAST(round(abs(value) * 100) AS BIGINT) * 1000000 AS en FROM events)"""
U = """U AS (
  SELECT g, CAST(sum(len) AS BIGINT) AS union_length, count(*) AS islands FROM (
    SELECT g, island, max(en) - min(st) AS len FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR st > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT g, st, en, max(en) OVER (PARTITION BY g ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {rows}))
    GROUP BY g, island) GROUP BY g)"""
PEAK = """PK AS (
  SELECT g, CAST(max(n) AS BIGINT) AS peak FROM (SELECT g, sum(d) OVER (PARTITION BY g ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT g, st AS t, 1 AS d FROM S UNION ALL SELECT g, en, -1 FROM S)) GROUP BY g)"""
P = f"""{S}, P AS (
  SELECT g || '-' || CAST((rn + 1) // 2 AS VARCHAR) AS park_id, g AS phase_id, CASE WHEN rn % 2 = 1 THEN 'open' ELSE 'close' END AS event, st AS at, rn // 8 AS boot
  FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY st, span_id) AS rn FROM S)),
PI AS (
  SELECT phase_id, park_id, min(at) FILTER (WHERE event = 'open') AS st, max(at) FILTER (WHERE event = 'close') AS en, min(boot) FILTER (WHERE event = 'open') AS boot,
    coalesce(min(boot) FILTER (WHERE event = 'open') = max(boot) FILTER (WHERE event = 'close'), false) AS exact FROM P GROUP BY ALL)"""
def json_of(*fields: str) -> str:
    """SQL for a JSON object of these fields in canonical form, for texts without escapes; size and revisions are numbers."""
    numbers = ("size", "changed_revision", "revision")
    value = lambda f: f"coalesce(CAST({f} AS VARCHAR), 'null')" if f in numbers else f"coalesce(chr(34) || {f} || chr(34), 'null')"
    return "'{' || " + " || ',' || ".join(f"'\"{f}\":' || " + value(f) for f in sorted(fields)) + " || '}'"


OUT = "OUT AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'stored' ELSE 'dedup' END AS outcome, row_number() OVER w - 1 AS prior_count FROM J WINDOW w AS (PARTITION BY cas_id ORDER BY ord))"


def quoted(sql: str) -> str:
    """The column `at` in double quotes: the word is reserved in the oracle's SQL."""
    return re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', sql)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = quoted(sql)
        return f

    return add


def simple(name: str, source, operator, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(source(spark, sf_dir))
    if sql:
        ORACLES[name] = quoted(sql)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.names(journal(spark, sf_dir))


# the journal and its index
simple("object_index", journal, index.objects, f"""WITH {J} SELECT cas_id, min(size) AS size, max_by(media_type, ord) AS media_type, min_by(at, ord) AS first_seen_utc, arg_min_null(batch, ord) AS batch,
  count(*) AS n_sightings, 'objects/sha256/' || substr(cas_id, 8, 2) || '/' || substr(cas_id, 10, 2) || '/' || substr(cas_id, 8) AS stored_relpath FROM J GROUP BY cas_id""")
simple("name_index", journal, index.names, f"WITH {J} SELECT cas_id, source_root_id, original_relpath, min_by(at, ord) AS recorded_utc FROM J GROUP BY ALL")
simple("store_totals", journal, index.totals, f"WITH {J}, O AS (SELECT cas_id, min(size) AS size, max(at) AS at FROM J GROUP BY cas_id) SELECT count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, max(at) AS last_ingest FROM O")
simple("ingest_outcomes", journal, lambda j: index.outcomes(j).select("event_id", "cas_id", "outcome", "prior_count"), f"WITH {J}, {OUT} SELECT event_id, cas_id, outcome, prior_count FROM OUT")
simple("ingest_summary", journal, index.ingest_summary, f"""WITH {J}, {OUT} SELECT source_root_id, count(*) AS files_seen, count(*) FILTER (WHERE outcome = 'stored') AS new_objects, count(*) FILTER (WHERE outcome = 'dedup') AS dedup_hits,
  CAST(sum(size) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(size) FILTER (WHERE outcome = 'stored'), 0) AS BIGINT) AS physical_bytes FROM OUT GROUP BY source_root_id""")
simple("dry_run_summary", journal, lambda j: index.dry_run_summary(j.filter("ord % 2 = 1"), j.filter("ord % 2 = 0")), f"""WITH {J}, N AS (SELECT *, cas_id IN (SELECT cas_id FROM J WHERE ord % 2 = 0) AS known FROM J WHERE ord % 2 = 1)
  SELECT count(*) AS files_seen, count(*) FILTER (WHERE NOT known) AS new_objects, count(*) FILTER (WHERE known) AS dedup_hits, CAST(coalesce(sum(size), 0) AS BIGINT) AS logical_bytes FROM N""")
simple("receipts_latest", journal, index.receipts, f"""WITH {J}, R AS (SELECT *, count(*) OVER w - 1 AS prior_sightings, first_value(at) OVER w AS first_seen, first_value(batch) OVER w AS first_batch, row_number() OVER (PARTITION BY cas_id ORDER BY ord DESC) AS rn
  FROM J WINDOW w AS (PARTITION BY cas_id ORDER BY ord)) SELECT cas_id, event_id, at, source_root_id, original_relpath, prior_sightings, first_seen, first_batch FROM R WHERE rn = 1""")
simple("live_prior_names", journal, index.live_prior_names, f"""WITH {J} SELECT a.event_id, (SELECT count(DISTINCT b.source_root_id || chr(31) || b.original_relpath) FROM J b WHERE b.cas_id = a.cas_id AND b.ord < a.ord) AS prior_names FROM J a""")
simple("media_conflicts", journal, index.media_conflicts, f"""WITH {J}, L AS (SELECT *, lag(media_type) OVER (PARTITION BY cas_id ORDER BY ord) AS before FROM J)
  SELECT cas_id, event_id, before, media_type FROM L WHERE before <> media_type AND NOT (before = 'application/zip' AND media_type = '{DOCX}')""")
LINES = f"LN AS (SELECT *, {json_of('at', 'batch', 'cas_id', 'event', 'event_id', 'media_type', 'original_relpath', 'outcome', 'schema', 'size', 'source_root_id')} AS line FROM (SELECT *, 'ingest' AS event, 'journal.v2' AS schema FROM OUT))"
LOCATED = f"{LINES}, LC AS (SELECT *, strlen(line) + 1 AS length, coalesce(sum(strlen(line) + 1) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\", sha256(line || chr(10)) AS sha256 FROM LN)"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal with all its eleven fields."""
    return index.outcomes(journal(spark, sf_dir)).drop("prior_count")


simple("journal_spans", whole, lambda j: index.located(j).select("event_id", "offset", "length", "sha256"), f'WITH {J}, {OUT}, {LOCATED} SELECT event_id, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, sha256 FROM LC')
simple("object_witness", whole, lambda j: index.witness(index.located(j)), f"""WITH {J}, {OUT}, {LOCATED} SELECT cas_id, count(*) AS records,
  sha256(string_agg(event_id || chr(9) || CAST("offset" AS VARCHAR) || chr(9) || CAST(length AS VARCHAR) || chr(9) || sha256 || chr(10), '' ORDER BY "offset")) AS digest FROM LC GROUP BY cas_id""")
simple("authority_commitment", whole, index.journal_commitment, f"""WITH {J}, {OUT}, {LINES}, B AS (SELECT ord // 4096 AS block, count(*) AS n, sha256(string_agg(line || chr(10), '' ORDER BY ord)) AS digest FROM LN GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM B""")
V1 = f"V1 AS (SELECT *, {json_of('at', 'batch', 'cas_id', 'event', 'media_type', 'mtime', 'original_relpath', 'outcome', 'size', 'source_root_id')} AS line FROM (SELECT *, at AS mtime, 'ingest' AS event FROM OUT))"
simple("migrate_v1", lambda s, d: whole(s, d).drop("event_id", "schema").withColumn("mtime", F.col("at")).withColumn("ord", F.col("ord") + 1), lambda r: composites.migrate_v1(r).select("ord", "event_id", "outcome"), f"""WITH {J}, {OUT}, {V1}
  SELECT ord + 1 AS ord, 'v1:' || lpad(CAST(ord + 1 AS VARCHAR), 16, '0') || ':sha256:' || sha256(line) AS event_id, outcome FROM V1""")


# lookups
@query("names_for_object", f"WITH {J} SELECT cas_id, source_root_id, original_relpath, min_by(at, ord) AS recorded_utc FROM J WHERE cas_id = (SELECT min(cas_id) FROM J) GROUP BY ALL")
def _names_for_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = journal(spark, sf_dir).agg(F.min("cas_id")).first()[0]
    return lookup.names_for(named(spark, sf_dir), least or "")


simple("find_names", named, lambda n: lookup.find_names(n, "/1"), f"WITH {J} SELECT cas_id, source_root_id, original_relpath, min_by(at, ord) AS recorded_utc FROM J WHERE instr(original_relpath, '/1') > 0 GROUP BY ALL")
simple("choose_name", named, lambda n: lookup.choose_name(n, "7.txt"), f"""WITH {J}, C AS (SELECT count(DISTINCT cas_id) AS n, min(original_relpath) AS only_one, min(original_relpath) FILTER (WHERE original_relpath = '7.txt') AS exact FROM J WHERE original_relpath = '7.txt' OR original_relpath LIKE '%/7.txt')
  SELECT coalesce(exact, CASE WHEN n = 1 THEN only_one END) AS chosen, exact IS NULL AND n > 1 AS ambiguous FROM C""")
simple("object_stat", journal, lambda j: lookup.object_stat(index.objects(j), index.names(j)).select("cas_id", "size", F.size("names").cast("bigint").alias("n_names")), f"WITH {J} SELECT cas_id, min(size) AS size, count(DISTINCT source_root_id || chr(31) || original_relpath) AS n_names FROM J GROUP BY cas_id")


# validators
@query("journal_record_errors", f"""WITH {J}, B AS (SELECT ord, CASE WHEN ord % 29 = 0 THEN 'x' || event_id ELSE event_id END AS event_id, CASE WHEN ord % 13 = 0 THEN '../' || original_relpath ELSE original_relpath END AS path, CASE WHEN ord % 31 = 0 THEN -1 ELSE size END AS size, CASE WHEN ord % 37 = 0 THEN '2026-13-01' ELSE at END AS at FROM J)
  SELECT ord, event_id, concat_ws(',', CASE WHEN ord % 29 = 0 THEN 'event-id' END, CASE WHEN size < 0 THEN 'size' END, CASE WHEN at = '2026-13-01' THEN 'time' END, CASE WHEN path LIKE '../%' THEN 'relpath' END) AS errors
  FROM B WHERE ord % 29 = 0 OR ord % 13 = 0 OR ord % 31 = 0 OR ord % 37 = 0""")
def _record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir).withColumn("outcome", F.lit("stored"))
    broken = {"event_id": (29, F.concat(F.lit("x"), F.col("event_id"))), "original_relpath": (13, F.concat(F.lit("../"), F.col("original_relpath"))), "size": (31, F.lit(-1)), "at": (37, F.lit("2026-13-01"))}
    return validate.record_errors(j.withColumns({c: F.when(F.col("ord") % n == 0, bad).otherwise(F.col(c)) for c, (n, bad) in broken.items()}))


@query("journal_order_violations", f"""WITH {J}, B AS (SELECT ord, CASE WHEN ord % 97 = 5 THEN 'v1:' || lpad('1', 16, '0') ELSE event_id END AS event_id, at FROM J),
  L AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, lag(at || event_id) OVER (ORDER BY ord) AS before FROM B)
  SELECT ord, event_id, concat_ws(',', CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN at || event_id < before THEN 'order' END) AS errors FROM L WHERE n > 1 OR at || event_id < before""")
def _order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    return validate.sequence_errors(j.withColumn("event_id", F.when(F.col("ord") % 97 == 5, F.concat(F.lit("v1:"), F.lpad(F.lit("1"), 16, "0"))).otherwise(F.col("event_id"))))


# replicas and integrity
def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    j = journal(spark, sf_dir)
    return j.filter("ord % 3 < 2"), j.filter("ord % 3 > 0")


@query("merge_union", f"WITH {J} SELECT event_id, cas_id, at FROM J WHERE ord % 3 < 2 UNION SELECT event_id, cas_id, at FROM J WHERE ord % 3 > 0")
def _merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.merge_union(*replicas(spark, sf_dir)).select("event_id", "cas_id", "at")


@query("merge_conflicts", f"WITH {J} SELECT event_id, CAST(2 AS BIGINT) AS versions FROM J WHERE ord % 3 = 1 AND ord % 10 = 1")
def _merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = replicas(spark, sf_dir)
    return verify.merge_conflicts(a, b.withColumn("media_type", F.when(F.col("ord") % 10 == 1, F.lit("changed")).otherwise(F.col("media_type"))))


@query("merge_object_plan", f"""WITH {J}, A AS (SELECT cas_id, min(size) AS s FROM J WHERE ord % 3 < 2 GROUP BY 1), B AS (SELECT cas_id, min(size) AS s FROM J WHERE ord % 3 > 0 GROUP BY 1)
  SELECT coalesce(A.cas_id, B.cas_id) AS cas_id, CASE WHEN B.s IS NULL THEN 'target' WHEN A.s IS NULL THEN 'source' ELSE 'both' END AS holder, coalesce(A.s <> B.s, false) AS size_conflict FROM A FULL JOIN B ON A.cas_id = B.cas_id""")
def _merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.merge_plan(*replicas(spark, sf_dir))


@query("verify_status", f"""WITH {J}, O AS (SELECT cas_id, min(ord) AS k FROM J GROUP BY 1)
  SELECT cas_id, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 29 = 0 THEN 'not regular' WHEN k % 31 = 0 THEN 'unreadable' WHEN k % 17 = 0 THEN 'size mismatch' WHEN k % 23 = 0 THEN 'writable' WHEN k % 19 = 0 THEN 'digest mismatch' ELSE 'ok' END AS status FROM O""")
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = journal(spark, sf_dir).groupBy("cas_id").agg(F.min("ord").alias("k"), F.min("size").alias("size"))
    files = o.filter("k % 13 <> 0").selectExpr("cas_id", "CASE WHEN k % 17 = 0 THEN size + 1 ELSE size END AS file_size", "CASE WHEN k % 19 = 0 THEN 'x' ELSE substring_index(cas_id, ':', -1) END AS file_digest", "k % 29 <> 0 AS regular", "k % 31 <> 0 AS readable", "k % 23 = 0 AS writable")
    return verify.statuses(o.select("cas_id", "size"), files)


@query("index_drift", f"""WITH {J}, O AS (SELECT cas_id, min(size) AS size, min(ord) AS k FROM J GROUP BY 1) SELECT cas_id, size + 1 AS size, 'stored' AS side, CAST(1 AS BIGINT) AS times FROM O WHERE k % 41 = 0
  UNION ALL SELECT cas_id, size, 'folded', CAST(1 AS BIGINT) FROM O WHERE k % 41 = 0""")
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = journal(spark, sf_dir).groupBy("cas_id").agg(F.min("size").alias("size"), F.min("ord").alias("k"))
    stored = folded.withColumn("size", F.when(F.col("k") % 41 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return verify.bag_difference(stored.drop("k"), folded.drop("k"))


@query("unjournaled_objects", f"""WITH {J}, A AS (SELECT DISTINCT cas_id FROM J WHERE ord % 7 <> 0), B AS (SELECT DISTINCT cas_id FROM J WHERE ord % 5 <> 0)
  SELECT cas_id, 'journal only' AS side FROM A WHERE cas_id NOT IN (SELECT cas_id FROM B) UNION ALL SELECT cas_id, 'tree only' FROM B WHERE cas_id NOT IN (SELECT cas_id FROM A)""")
def _unjournaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    return verify.one_sided(j.filter("ord % 7 <> 0"), j.filter("ord % 5 <> 0"))


# excision
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ord"))
    return journal(spark, sf_dir).join(toxic, "ord", "left_semi").select("cas_id").distinct()


SEL = "SEL AS (SELECT DISTINCT cas_id FROM J WHERE ord IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query("excise_retained", f"WITH {J}, {SEL} SELECT event_id, cas_id FROM J WHERE cas_id NOT IN (SELECT cas_id FROM SEL)")
def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excise.retained(journal(spark, sf_dir).select("event_id", "cas_id"), selection(spark, sf_dir))


@query("excise_shared_owners", f"WITH {J}, {SEL} SELECT cas_id, event_id AS owner_id FROM J WHERE cas_id IN (SELECT cas_id FROM SEL) AND ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ord"))
    j = journal(spark, sf_dir).withColumnRenamed("event_id", "owner_id")
    return excise.shared_owners(j.select("owner_id", "cas_id"), selection(spark, sf_dir), j.join(toxic, "ord", "left_semi").select("owner_id"))


@query("content_literal_refs", f"WITH {J} SELECT DISTINCT event_id AS owner, cas_id FROM J WHERE ord % 5 = 0")
def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    written = journal(spark, sf_dir).join(texts, "ord").select(F.col("event_id").alias("owner"), F.when(F.col("ord") % 5 == 0, F.concat_ws(" see ", "text", "cas_id")).otherwise(F.col("text")).alias("content"))
    return excise.literal_references(written)


@query("dependency_edges", f"""WITH {J} SELECT 'entry' AS owner_kind, source_root_id AS owner_id, cas_id FROM J UNION SELECT 'operation', batch, cas_id FROM J WHERE batch IS NOT NULL UNION SELECT 'snapshot', 's' || CAST(ord % 3 AS VARCHAR), cas_id FROM J WHERE ord % 2 = 0""")
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    return excise.dependency_edges(j.selectExpr("source_root_id AS owner_id", "cas_id"), j.filter("batch IS NOT NULL").selectExpr("batch AS owner_id", "cas_id"), j.filter("ord % 2 = 0").selectExpr("concat('s', ord % 3) AS owner_id", "cas_id"))


# the tree
CL = "WITH RECURSIVE {E}, C AS (SELECT entry_id, kind, 0 AS level FROM E WHERE entry_id = 'r1' UNION ALL SELECT E.entry_id, E.kind, C.level + 1 FROM C JOIN E ON E.parent_id = C.entry_id WHERE C.kind = 'directory')"
PT = "PT AS (SELECT entry_id, 0 AS depth, '' AS path FROM E WHERE parent_id IS NULL UNION ALL SELECT E.entry_id, PT.depth + 1, PT.path || '/' || E.name FROM PT JOIN E ON E.parent_id = PT.entry_id)"
simple("tree_closure", entries, lambda e: tree.closure(e, "r1"), CL.replace("{E}", E) + " SELECT entry_id, kind, CAST(level AS BIGINT) AS level FROM C")
simple("tree_depth", entries, lambda e: tree.paths(e).groupBy("depth").agg(F.count("*").alias("n")), f"WITH RECURSIVE {E}, {PT} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM PT GROUP BY 1")
simple("tree_paths", entries, tree.paths, f"WITH RECURSIVE {E}, {PT} SELECT entry_id, CAST(depth AS BIGINT) AS depth, path FROM PT")
simple("tree_orphans", lambda s, d: entries(s, d).withColumn("live", F.when(F.col("entry_id") == "n3", 0).otherwise(F.col("live"))), tree.orphans, f"WITH {E} SELECT entry_id, parent_id FROM E WHERE live = 1 AND parent_id = 'n3'")
simple("tree_bad_parents", lambda s, d: entries(s, d).withColumn("live", F.when(F.col("entry_id").isin("n3", "r2"), 0).otherwise(F.col("live"))), tree.bad_parents, f"WITH {E} SELECT entry_id, parent_id FROM E WHERE live = 1 AND parent_id IN ('n3', 'r2') AND entry_id <> 'n3'")
simple("sibling_conflicts", lambda s, d: entries(s, d).withColumn("name", F.when(F.col("kind") == "file", F.substring("name", -1, 1)).otherwise(F.col("name"))), tree.sibling_conflicts, f"""WITH {E}, K AS (SELECT parent_id, lower(CASE WHEN kind = 'file' THEN right(name, 1) ELSE name END) AS comparison_key FROM E WHERE live = 1 AND parent_id IS NOT NULL)
  SELECT parent_id, comparison_key, count(*) AS n FROM K GROUP BY ALL HAVING count(*) > 1""")
ENTRY_JSON = "'{\"cas_id\":null,\"changed_revision\":' || CAST(changed_revision AS VARCHAR) || ',\"entry_id\":\"' || entry_id || '\",\"kind\":\"' || kind || '\",\"metadata\":{},\"name\":' || coalesce('\"' || name || '\"', 'null') || ',\"parent_id\":' || coalesce('\"' || parent_id || '\"', 'null') || ',\"size\":' || coalesce(CAST(size AS VARCHAR), 'null') || '}'"
simple("tree_totals", entries, tree.totals, f"WITH {E} SELECT count(*) AS live_entries, CAST(sum(strlen({ENTRY_JSON})) AS BIGINT) AS entry_bytes, count(*) FILTER (WHERE kind = 'file') AS live_files FROM E WHERE live = 1")
simple("entry_ancestors", entries, lambda e: tree.ancestors(e, e.filter("kind = 'file' AND live = 1")).select("entry_id", "ancestor_id", "level"), f"""WITH RECURSIVE {E}, A AS (SELECT entry_id, entry_id AS ancestor_id, 0 AS level FROM E WHERE kind = 'file' AND live = 1
  UNION ALL SELECT A.entry_id, E.parent_id, A.level + 1 FROM A JOIN E ON E.entry_id = A.ancestor_id WHERE E.parent_id IS NOT NULL) SELECT entry_id, ancestor_id, CAST(level AS BIGINT) AS level FROM A""")
simple("live_counts", entries, lambda e: e.groupBy("live").agg(F.count("*").alias("n")), f"WITH {E} SELECT CAST(live AS INT) AS live, count(*) AS n FROM E GROUP BY 1")
simple("directory_page", entries, lambda e: lookup.directory_page(e, "n1", "customer#0000", 20), f"""WITH {E}, K AS (SELECT *, row_number() OVER (ORDER BY lower(name), entry_id) AS rn, count(*) OVER () AS n FROM E WHERE parent_id = 'n1' AND live = 1 AND lower(name) > 'customer#0000')
  SELECT entry_id, kind, name, CASE WHEN rn = 20 AND n > 20 THEN name END AS next_name FROM K WHERE rn <= 20""")
simple("changes_since", entries, lambda e: lookup.changes_since(e, 105, "c5", 100), f"""WITH {E}, K AS (SELECT *, row_number() OVER (ORDER BY touched_revision, entry_id) AS rn, count(*) OVER () AS n FROM E WHERE touched_revision > 105 OR (touched_revision = 105 AND entry_id > 'c5'))
  SELECT touched_revision, entry_id, kind, CAST(live AS INT) AS live, CASE WHEN rn = 100 AND n > 100 THEN touched_revision END AS next_revision, CASE WHEN rn = 100 AND n > 100 THEN entry_id END AS next_entry_id FROM K WHERE rn <= 100""")
simple("state_at_revision", entries, lambda e: tree.state_at(tree.creation_log(e), 150).select("entry_id", "kind", "name"), f"WITH {E} SELECT entry_id, kind, name FROM E WHERE changed_revision <= 150")


@query("epoch_asof", f"""WITH {E}, EP AS (SELECT k AS generation, k * 50 AS start FROM range(10) t(k)), A AS (SELECT entry_id, touched_revision AS revision, max(start) AS epoch_start FROM E JOIN EP ON start <= touched_revision GROUP BY ALL)
  SELECT entry_id, revision, generation, epoch_start FROM A JOIN EP ON start = epoch_start""")
def _epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = spark.range(10).selectExpr("id AS generation", "id * 50 AS start")
    return lookup.epoch_at(entries(spark, sf_dir).select("entry_id", F.col("touched_revision").alias("revision")), epochs)


# onboarding
simple("ambiguous_paths", journal, onboard.ambiguous_paths, f"WITH {J} SELECT source_root_id, original_relpath, count(DISTINCT cas_id) AS contents FROM J GROUP BY 1, 2 HAVING count(DISTINCT cas_id) > 1")


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = r"^[a-z]+://([^/]*)(.*)$"
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("cas_id"), F.regexp_extract("url", url, 1).alias("source_root_id"), F.regexp_extract("url", url, 2).alias("original_relpath"))


PG = "PG AS (SELECT CAST(page_id AS VARCHAR) AS cas_id, regexp_extract(url, '^[a-z]+://([^/]*)(.*)$', 1) AS source_root_id, regexp_extract(url, '^[a-z]+://([^/]*)(.*)$', 2) AS original_relpath FROM pages)"
simple("cross_source_paths", page_names, onboard.cross_source_paths, f"WITH {PG} SELECT original_relpath, count(DISTINCT source_root_id) AS sources FROM PG GROUP BY 1 HAVING count(DISTINCT source_root_id) > 1")
simple("normalized_collisions", lambda s, d: journal(s, d).withColumn("original_relpath", F.when(F.col("ord") % 3 == 0, F.upper("original_relpath")).otherwise(F.col("original_relpath"))), onboard.normalized_collisions, f"""WITH {J}, K AS (SELECT source_root_id, lower(original_relpath) AS path_key, CASE WHEN ord % 3 = 0 THEN upper(original_relpath) ELSE original_relpath END AS p FROM J)
  SELECT source_root_id, path_key, count(DISTINCT p) AS spellings FROM K GROUP BY 1, 2 HAVING count(DISTINCT p) > 1""")
simple("normalized_keys_unicode", journal, lambda j: onboard.normalized_collisions(j.withColumn("original_relpath", F.concat(F.col("original_relpath"), F.when(F.col("ord") % 3 == 0, "Straße").otherwise("STRASSE"))), path_key_udf("original_relpath")))
simple("canonical_lines", journal, lambda j: j.select("event_id", canonical_line_udf(F.to_json(F.struct("event_id", "at", "cas_id", "size", "batch"), {"ignoreNullFields": "false"})).alias("line")), f"""WITH {J} SELECT event_id, '{{"at":"' || at || '","batch":' || coalesce('"' || batch || '"', 'null') || ',"cas_id":"' || cas_id || '","event_id":"' || event_id || '","size":' || CAST(size AS VARCHAR) || '}}' AS line FROM J""")


@query("disclosure_fixpoint", f"""WITH RECURSIVE {J}, {SEL}, G AS (SELECT DISTINCT a.cas_id AS owner, b.cas_id FROM J a JOIN J b ON b.ord = a.ord - 1 AND a.ord % 4 <> 0), D AS (SELECT cas_id FROM SEL UNION SELECT G.owner FROM D JOIN G ON G.cas_id = D.cas_id) SELECT cas_id FROM D""")
def _fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    before = j.select((F.col("ord") + 1).alias("ord"), F.col("cas_id"))
    edges = j.filter("ord % 4 <> 0").select("ord", F.col("cas_id").alias("owner")).join(before, "ord").select("owner", "cas_id").distinct()
    return excise.disclosures(selection(spark, sf_dir), edges)


# intervals
simple("interval_union", spans, intervals.union_length, f"WITH {S}, {U.replace('{rows}', 'S')} SELECT * FROM U")
simple("peak_concurrency", spans, intervals.peak_concurrency, f"WITH {S}, {PEAK} SELECT * FROM PK")
simple("exclusive_coverage", spans, intervals.exclusive, f"""WITH {S}, B AS (SELECT g, st AS s0 FROM S WHERE en > st UNION SELECT g, en FROM S WHERE en > st), SG AS (SELECT g, s0, lead(s0) OVER (PARTITION BY g ORDER BY s0) AS s1 FROM B),
  R AS (SELECT SG.g, category, s1 - s0 AS len, row_number() OVER (PARTITION BY SG.g, s0 ORDER BY depth DESC, en - st, span_id DESC) AS rn FROM SG JOIN S ON S.g = SG.g AND st <= s0 AND en >= s1 AND en > st)
  SELECT g, category, CAST(sum(len) AS BIGINT) AS exclusive FROM R WHERE rn = 1 GROUP BY ALL""")
GM = f"""WITH {S}, {U.replace('{rows}', 'S')}, {PEAK}, M AS (SELECT g, count(*) AS members, CAST(sum(en - st) AS BIGINT) AS summed, max(en) - min(st) AS "window" FROM S GROUP BY g)
  SELECT M.*, union_length, peak, summed - union_length AS overlap, CASE WHEN union_length > 0 THEN round(summed / union_length, 6) ELSE 0.0 END AS ratio FROM M JOIN U USING (g) JOIN PK USING (g)"""
simple("group_metrics", spans, intervals.group_metrics, GM)
COV = [U.replace("U AS", f"{n} AS").replace("{rows}", f"(SELECT * FROM S WHERE {w})") for n, w in (("U1", "true"), ("U2", "outcome = 'failed'"), ("U3", "attempt > 1"))]
simple("coverage_summary", spans, intervals.coverage, f"""WITH {S}, {', '.join(COV)}, M AS (SELECT g, max(en) - min(st) AS makespan FROM S GROUP BY g) SELECT M.g, makespan, coalesce(U1.union_length, 0) AS covered, coalesce(U2.union_length, 0) AS failed, coalesce(U3.union_length, 0) AS retried,
  greatest(makespan - coalesce(U1.union_length, 0), 0) AS unattributed FROM M LEFT JOIN U1 USING (g) LEFT JOIN U2 USING (g) LEFT JOIN U3 USING (g)""")
simple("slowest_spans", spans, intervals.slowest, f"WITH {S} SELECT span_id, category, en - st AS duration FROM S ORDER BY duration DESC, span_id LIMIT 10")
simple("attempt_summary", spans, intervals.attempts, f"WITH {S} SELECT g, category, count(*) AS n, CAST(max(attempt) AS BIGINT) AS most, count(*) FILTER (WHERE outcome = 'failed') AS failures FROM S GROUP BY 1, 2 HAVING count(*) > 1 OR max(attempt) > 1")
simple("role_breakdown", spans, intervals.role_breakdown, f"""WITH {S}, {U.replace('{rows}', '(SELECT category AS g, st, en FROM S)')}, R AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE outcome = 'failed') AS failures, CAST(sum(en - st) AS BIGINT) AS summed, count(DISTINCT attempt) AS attempts FROM S GROUP BY 1)
  SELECT R.*, union_length FROM R JOIN U ON U.g = category""")
simple("pass_numbers", spans, intervals.pass_numbers, f'WITH {S} SELECT g, category, span_id, row_number() OVER (PARTITION BY g, category ORDER BY st, span_id) AS "pass" FROM S')
simple("prev_next", spans, intervals.neighbours, f'WITH {S} SELECT g, span_id, lag(span_id) OVER w AS previous, lead(span_id) OVER w AS "next" FROM S WINDOW w AS (PARTITION BY g ORDER BY st, span_id)')
simple("park_intervals", parks, intervals.park_intervals, f"WITH {P} SELECT phase_id, park_id, st, en, boot, exact FROM PI")
simple("park_summary", parks, intervals.park_summary, f"""WITH {P}, CLOSED AS (SELECT * FROM PI WHERE en IS NOT NULL), F AS (SELECT phase_id, count(*) AS parks, bool_or(en IS NULL) AS open, bool_and(exact) AS all_exact FROM PI GROUP BY 1),
  {U.replace('U AS', 'UB AS').replace('{rows}', "(SELECT phase_id || ':' || boot AS g, st, en FROM CLOSED)")}, {U.replace('U AS', 'UC AS').replace('{rows}', '(SELECT phase_id AS g, st, en FROM CLOSED)')},
  BB AS (SELECT CAST(split_part(g, ':', 1) AS BIGINT) AS phase_id, CAST(sum(union_length) AS BIGINT) AS n FROM UB GROUP BY 1)
  SELECT F.phase_id, parks, CASE WHEN open THEN NULL WHEN all_exact THEN BB.n ELSE UC.union_length END AS total, CASE WHEN open THEN 'incomplete' WHEN all_exact THEN 'exact-union' ELSE 'calendar-union-cross-boot' END AS method
  FROM F LEFT JOIN BB USING (phase_id) LEFT JOIN UC ON UC.g = F.phase_id""")
simple("recent_history", spans, lambda s: lookup.recent(s, "g", "st", 3).select("g", "span_id", "st"), f"WITH {S} SELECT g, span_id, st FROM S QUALIFY row_number() OVER (PARTITION BY g ORDER BY st DESC, span_id DESC) <= 3")

# chains, logs, proofs
CE = "CE AS (SELECT conv_id AS chain, conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS previous, turn AS position, role AS state FROM conversations)"
simple("chain_heads", chain_events, chains.heads, f"WITH {CE} SELECT chain, id, state FROM CE WHERE id NOT IN (SELECT previous FROM CE WHERE previous IS NOT NULL)")
ODD = CE.replace("CE AS (", "CE AS (SELECT * REPLACE (CASE WHEN chain % 5 = 2 AND position = 2 THEN 'system' ELSE state END AS state) FROM (") + " WHERE NOT (chain % 7 = 3 AND position = 1))"


def odd_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with events lost and states changed."""
    state = F.when((F.col("chain") % 5 == 2) & (F.col("position") == 2), "system").otherwise(F.col("state"))
    return chain_events(spark, sf_dir).withColumn("state", state).filter("NOT (chain % 7 = 3 AND position = 1)")


simple("chain_violations", odd_chains, chains.violations, f"""WITH {ODD}, B AS (SELECT DISTINCT id AS previous, state AS from_state FROM CE), V AS (SELECT chain, id, from_state, state, CASE WHEN from_state IS NULL THEN 'previous missing' WHEN NOT ((from_state = 'system' AND state = 'user') OR (from_state = 'user' AND state = 'assistant') OR (from_state = 'assistant' AND state = 'user')) THEN 'transition' END AS fault
  FROM CE LEFT JOIN B USING (previous) WHERE CE.previous IS NOT NULL) SELECT * FROM V WHERE fault IS NOT NULL""")
simple("chronology_regressions", spans, lambda s: chains.regressions(s.withColumn("at", F.col("en")), "at", "span_id", "g").select("g", "span_id", "at", "before"), f"WITH {S}, L AS (SELECT g, span_id, en AS at, lag(en) OVER (PARTITION BY g ORDER BY span_id) AS before FROM S) SELECT * FROM L WHERE at < before")
simple("regressions_overall", spans, lambda s: chains.regressions(s.withColumn("at", F.col("en")), "at", "span_id").select("span_id", "at", "before"), f"WITH {S}, L AS (SELECT span_id, en AS at, lag(en) OVER (ORDER BY span_id) AS before FROM S) SELECT * FROM L WHERE at < before")
FAMILIES = {"english": ["en/*"], "romance": ["fr/*", "es/*"], "threes": ["*/3?.txt", "*/3.txt"]}
simple("glob_selectors", journal, lambda j: chains.selected(j.select("event_id", "original_relpath"), FAMILIES, "original_relpath").groupBy("family").agg(F.count("*").alias("n")), f"""WITH {J} SELECT 'english' AS family, count(*) AS n FROM J WHERE original_relpath GLOB 'en/*' UNION ALL SELECT 'romance', count(*) FROM J WHERE original_relpath GLOB 'fr/*' OR original_relpath GLOB 'es/*'
  UNION ALL SELECT 'threes', count(*) FROM J WHERE regexp_full_match(original_relpath, '.*/3.?\\.txt')""")
simple("proof_counts", lambda s, d: table(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("family")), chains.proof_counts, "SELECT p_type AS kind, count(*) AS proofs, count(DISTINCT p_brand) AS families FROM part GROUP BY 1")
