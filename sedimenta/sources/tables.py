"""Journals, trees, spans and parks derived from the shared tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.schemas import DOCX, JOURNAL_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(seconds: str) -> str:
    """SQL for 2026-01-01T00:00:00Z plus so many seconds, as text; free of the session's time zone."""
    return f"concat(date_add(DATE'2026-01-01', CAST({seconds} DIV 86400 AS INT)), 'T', lpad({seconds} DIV 3600 % 24, 2, '0'), ':', lpad({seconds} DIV 60 % 60, 2, '0'), ':', lpad({seconds} % 60, 2, '0'), 'Z')"


def event_id(number: str) -> str:
    """SQL for an event id of the minted form, drawn from a number's md5."""
    digest = f"md5(CAST({number} AS STRING))"
    return f"concat('uuid:', substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-4', substr({digest}, 14, 3), '-8', substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal, with `ord` for its order: an ingest event for every document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS ord",
        f"'{JOURNAL_SCHEMA}' AS schema",
        f"{event_id('doc_id')} AS event_id",
        f"{instant('doc_id')} AS at",
        "'ingest' AS event",
        "concat('sha256:', sha2(text, 256)) AS cas_id",
        "CAST(octet_length(text) AS BIGINT) AS size",
        f"CASE doc_id % 11 WHEN 0 THEN 'application/zip' WHEN 1 THEN '{DOCX}' ELSE 'text/plain' END AS media_type",
        "source AS source_root_id",
        "concat(lang, '/', CAST(doc_id % 37 AS STRING), '.txt') AS original_relpath",
        "CASE WHEN doc_id % 5 <> 0 THEN concat('b', CAST(doc_id % 4 AS STRING)) END AS batch",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: root, regions, nations (directories) and customers (files). Every 17th customer was deleted at a later revision."""
    root = spark.range(1).selectExpr("'/' AS entry_id", "'directory' AS kind", "CAST(NULL AS STRING) AS parent_id", "CAST(NULL AS STRING) AS name", "CAST(NULL AS BIGINT) AS size", "0L AS changed_revision", "1 AS live", "0L AS touched_revision")
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey)", "'directory'", "'/'", "r_name", "CAST(NULL AS BIGINT)", "r_regionkey + 1L", "1", "r_regionkey + 1L")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey)", "'directory'", "concat('r', n_regionkey)", "n_name", "CAST(NULL AS BIGINT)", "n_nationkey + 10L", "1", "n_nationkey + 10L")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_custkey)", "'file'", "concat('n', c_nationkey)", "c_name", "CAST(octet_length(c_name) AS BIGINT)", "c_custkey + 100", "CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END", "c_custkey + CASE WHEN c_custkey % 17 = 0 THEN 1000000 ELSE 100 END"
    )
    return root.union(regions).union(nations).union(customers)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in microseconds: g (group), span_id, category, depth, attempt, outcome, st, en."""
    start = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS g", "event_id AS span_id", "event_type AS category", "CAST(event_id % 3 AS INT) AS depth", "CAST(event_id % 4 + 1 AS INT) AS attempt", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome", f"{start} AS st", f"{start} + CAST(round(abs(value) * 100) AS BIGINT) * 1000000 AS en"
    )


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and close events: within a user, odd rows open a park and the next row closes it; boots change every eight rows."""
    rows = spans(spark, sf_dir).selectExpr("g", "st AS at", "span_id", "row_number() OVER (PARTITION BY g ORDER BY st, span_id) AS rn")
    return rows.selectExpr("concat(g, '-', CAST((rn + 1) DIV 2 AS STRING)) AS park_id", "g AS phase_id", "CASE WHEN rn % 2 = 1 THEN 'open' ELSE 'close' END AS event", "at", "CAST(rn DIV 8 AS BIGINT) AS boot", "span_id AS ord")


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event chains from conversations: chain, id, previous, state."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS chain", "concat(conv_id, ':', turn) AS id", "CASE WHEN turn > 0 THEN concat(conv_id, ':', turn - 1) END AS previous", "turn AS position", "role AS state")


#: SQL for the eight hexadecimal digits of a span's cycle; it holds in Spark and in the oracle.
CYCLE = "substr(md5(CAST(span_id % 40 AS STRING)), 1, 8)"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user: a root over all the user's spans, which hang in chains of three below it."""
    rows = spans(spark, sf_dir).withColumn("rn", F.expr("row_number() OVER (PARTITION BY g ORDER BY st, span_id)")).withColumn("before", F.expr("lag(span_id) OVER (PARTITION BY g ORDER BY st, span_id)"))
    span = rows.selectExpr(
        "g AS trace_id", "span_id", "CASE WHEN rn % 3 = 1 THEN -g - 1 ELSE before END AS parent_span_id",
        "CASE category WHEN 'view' THEN 'gate' WHEN 'purchase' THEN 'reconciliation' WHEN 'signup' THEN 'wait' ELSE 'intelligence' END AS category",
        f"CASE category WHEN 'view' THEN concat('gate.', span_id % 7) WHEN 'purchase' THEN concat(CASE span_id % 3 WHEN 0 THEN 'batch.commit.' WHEN 1 THEN 'batch.quarantine.' ELSE 'batch.telemetry-incomplete.' END, {CYCLE}) WHEN 'signup' THEN concat('checkpoint.cycle.', {CYCLE}) ELSE concat('role.cycle.', {CYCLE}) END AS operation",
        "CASE WHEN span_id % 4 = 0 THEN 2 ELSE 1 END AS attempt", "CASE WHEN category = 'error' OR span_id % 11 = 0 THEN 'error' ELSE 'success' END AS outcome", "st", "en",
        "elt(CAST(span_id % 3 + 1 AS INT), 'coder', 'planner', 'reviewer') AS role", "concat('m', span_id % 2) AS model", "concat('h', span_id % 5) AS harness",
        "CASE WHEN span_id % 4 = 1 THEN concat('group', span_id % 3) END AS concurrency_group",
        "CASE WHEN span_id % 6 = 0 THEN concat('l', span_id % 2) END AS token_ledger", f"CASE WHEN span_id % 6 = 0 THEN {CYCLE} END AS token_cycle", "CASE WHEN span_id % 6 = 0 THEN 'planner' END AS token_role",
    )
    facts = rows.groupBy("g").agg(F.min("st").alias("st"), F.max("en").alias("en"))
    none = [f"CAST(NULL AS STRING) AS {c}" for c in ("role", "model", "harness", "concurrency_group", "token_ledger", "token_cycle", "token_role")]
    root = facts.selectExpr("g AS trace_id", "-g - 1 AS span_id", "CAST(NULL AS BIGINT) AS parent_span_id", "'run' AS category", "concat('phase.', g % 12) AS operation", "1 AS attempt", "CASE WHEN g % 7 = 3 THEN 'error' ELSE 'success' END AS outcome", "st", "en", *none)
    of_root = facts.selectExpr("g AS trace_id", "elt(CAST(g % 3 + 1 AS INT), 'improve-batch', 'checkpoint', 'kickoff') AS run_type", "CASE WHEN g % 4 = 0 THEN 'engine' ELSE 'project' END AS scope", "concat('b', g % 10) AS batch_id", "en AS finalized_at")
    return span.unionByName(root).join(of_root, "trace_id")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expected run for every third user; some never got a trace, some name one that is not there."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 3 < 2")
    return users.selectExpr(
        "user_id AS run_id", "CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN user_id + 1000000 ELSE user_id END AS trace_id", "elt(CAST(user_id % 4 + 1 AS INT), 'trace-bound', 'incomplete', 'finalized', 'committed') AS lifecycle_state",
        "CASE WHEN user_id % 2 = 0 THEN 'E1' END AS error_code", "substr(md5(CAST(user_id % 40 AS STRING)), 1, 8) AS cycle_id", "user_id * 1000 AS updated_at",
    )
