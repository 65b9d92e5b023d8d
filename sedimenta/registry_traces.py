"""The queries over traces, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import traces as tr
from sedimenta.registry import S, U, query, simple
from sedimenta.sources.tables import expectations, traces

C = "substr(md5(CAST(span_id % 40 AS VARCHAR)), 1, 8)"
T = f"""{S}, TR AS (SELECT *, row_number() OVER w AS rn, lag(span_id) OVER w AS before FROM S WINDOW w AS (PARTITION BY g ORDER BY st, span_id)),
TS AS (SELECT g AS trace_id, span_id, CASE WHEN rn % 3 = 1 THEN -g - 1 ELSE before END AS parent_span_id,
    CASE category WHEN 'view' THEN 'gate' WHEN 'purchase' THEN 'reconciliation' WHEN 'signup' THEN 'wait' ELSE 'intelligence' END AS category,
    CASE category WHEN 'view' THEN 'gate.' || (span_id % 7) WHEN 'purchase' THEN CASE span_id % 3 WHEN 0 THEN 'batch.commit.' WHEN 1 THEN 'batch.quarantine.' ELSE 'batch.telemetry-incomplete.' END || {C} WHEN 'signup' THEN 'checkpoint.cycle.' || {C} ELSE 'role.cycle.' || {C} END AS operation,
    CASE WHEN span_id % 4 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN category = 'error' OR span_id % 11 = 0 THEN 'error' ELSE 'success' END AS outcome, st, en,
    CASE span_id % 3 WHEN 0 THEN 'coder' WHEN 1 THEN 'planner' ELSE 'reviewer' END AS role, 'm' || (span_id % 2) AS model, 'h' || (span_id % 5) AS harness, CASE WHEN span_id % 4 = 1 THEN 'group' || (span_id % 3) END AS concurrency_group,
    CASE WHEN span_id % 6 = 0 THEN 'l' || (span_id % 2) END AS token_ledger, CASE WHEN span_id % 6 = 0 THEN {C} END AS token_cycle, CASE WHEN span_id % 6 = 0 THEN 'planner' END AS token_role,
    CASE WHEN rn % 3 = 1 THEN 1 WHEN rn % 3 = 2 THEN 2 ELSE 3 END AS depth FROM TR),
RT AS (SELECT g AS trace_id, -g - 1 AS span_id, min(st) AS st, max(en) AS en, CASE g % 3 WHEN 0 THEN 'improve-batch' WHEN 1 THEN 'checkpoint' ELSE 'kickoff' END AS run_type, CASE WHEN g % 4 = 0 THEN 'engine' ELSE 'project' END AS scope,
    'b' || (g % 10) AS batch_id, max(en) AS finalized_at, 'phase.' || (g % 12) AS operation, CASE WHEN g % 7 = 3 THEN 'error' ELSE 'success' END AS outcome FROM S GROUP BY g),
CH AS (SELECT TS.*, run_type, scope, batch_id, finalized_at FROM TS JOIN RT USING (trace_id))"""


def union(name: str, rows: str, by: str = "trace_id") -> str:
    """A table of union lengths by g; rows must have g, st and en."""
    return U.replace("U AS", f"{name} AS").replace("{rows}", f"(SELECT {by} AS g, st, en FROM {rows})")


def peak(name: str, rows: str) -> str:
    return f"{name} AS (SELECT g, CAST(max(n) AS BIGINT) AS peak FROM (SELECT g, sum(d) OVER (PARTITION BY g ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT trace_id AS g, st AS t, 1 AS d FROM {rows} UNION ALL SELECT trace_id, en, -1 FROM {rows})) GROUP BY g)"


def exclusive(name: str, rows: str, by: str, label: str) -> str:
    """name(g, label, exclusive): segments of each group, each to its deepest, then shortest, then greatest span."""
    return f"""{name}B AS (SELECT {by} AS g, st AS s0 FROM {rows} WHERE en > st UNION SELECT {by}, en FROM {rows} WHERE en > st), {name}S AS (SELECT g, s0, lead(s0) OVER (PARTITION BY g ORDER BY s0) AS s1 FROM {name}B),
{name} AS (SELECT g, label, CAST(sum(len) AS BIGINT) AS exclusive FROM (SELECT b.g, {label} AS label, s1 - s0 AS len, row_number() OVER (PARTITION BY b.g, s0 ORDER BY depth DESC, en - st, span_id DESC) AS rn FROM {name}S b JOIN {rows} r ON r.{by} = b.g AND st <= s0 AND en >= s1 AND en > st) WHERE rn = 1 GROUP BY ALL)"""


def after(prefix: str) -> str:
    return f"CASE WHEN starts_with(operation, '{prefix}') THEN substr(operation, {len(prefix) + 1}) END"


simple("batch_metrics", traces, tr.batch_metrics, f"""WITH {T}, OWN AS (SELECT * FROM CH WHERE run_type = 'improve-batch'), M AS (SELECT *, regexp_extract(operation, '^role\\.cycle\\.([0-9a-f]{{8}})$', 1) AS cycle FROM OWN WHERE category = 'intelligence'),
  CM AS (SELECT DISTINCT trace_id, {after('batch.commit.')} AS cycle FROM OWN WHERE outcome = 'success' AND starts_with(operation, 'batch.commit.')), BC AS (SELECT trace_id, cycle, count(*) AS n, sum(en - st) AS work, max(attempt) AS most, bool_or(outcome = 'success') AS ok FROM M WHERE cycle <> '' GROUP BY ALL),
  B2 AS (SELECT BC.trace_id, count(*) AS launched_members, count(*) FILTER (WHERE NOT ok) AS failed_members, count(*) FILTER (WHERE n > 1 OR most > 1) AS retried_members, CAST(sum(work) AS BIGINT) AS summed_member_work, CAST(coalesce(sum(work) FILTER (WHERE CM.cycle IS NOT NULL), 0) AS BIGINT) AS committed_member_work FROM BC LEFT JOIN CM ON CM.trace_id = BC.trace_id AND CM.cycle = BC.cycle GROUP BY 1),
  TD AS (SELECT trace_id, count(DISTINCT CASE WHEN outcome = 'success' THEN {after('batch.commit.')} END) AS committed_members, count(DISTINCT {after('batch.quarantine.')}) AS quarantined_members, count(DISTINCT {after('batch.telemetry-incomplete.')}) AS telemetry_incomplete_members FROM OWN GROUP BY 1),
  W AS (SELECT trace_id, max(en) - min(st) AS member_window FROM M GROUP BY 1), {union('UN', 'M')}, {peak('PM', 'M')},
  A AS (SELECT RT.trace_id, RT.en - RT.st AS batch_makespan, coalesce(committed_members, 0) AS committed_members, coalesce(quarantined_members, 0) AS quarantined_members, coalesce(telemetry_incomplete_members, 0) AS telemetry_incomplete_members, coalesce(launched_members, 0) AS launched_members, coalesce(failed_members, 0) AS failed_members,
    coalesce(retried_members, 0) AS retried_members, coalesce(summed_member_work, 0) AS summed_member_work, coalesce(committed_member_work, 0) AS committed_member_work, coalesce(member_window, 0) AS member_window, coalesce(union_length, 0) AS member_active_union, coalesce(peak, 0) AS peak_concurrency
    FROM RT LEFT JOIN B2 USING (trace_id) LEFT JOIN TD USING (trace_id) LEFT JOIN W USING (trace_id) LEFT JOIN UN ON UN.g = RT.trace_id LEFT JOIN PM ON PM.g = RT.trace_id WHERE run_type = 'improve-batch')
  SELECT *, summed_member_work - member_active_union AS overlap, batch_makespan // nullif(committed_members, 0) AS makespan_per_committed, CASE WHEN committed_members = 0 THEN 'no committed members' END AS makespan_per_committed_reason,
    summed_member_work / nullif(member_window, 0) AS work_to_window_ratio, committed_member_work / nullif(batch_makespan, 0) AS observed_speedup, CASE WHEN batch_makespan = 0 THEN 'zero batch makespan' END AS observed_speedup_reason FROM A""")
joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
simple("token_references", traces, lambda s: tr.token_references(s).select("trace_id", "token_ledger", "token_cycle", "token_role", joined("span_ids")), f"WITH {T} SELECT trace_id, token_ledger, token_cycle, token_role, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY span_id) AS span_ids FROM TS WHERE token_ledger IS NOT NULL GROUP BY ALL")
simple("trace_concurrency_groups", traces, tr.concurrency_groups, f"""WITH {T}, G AS (SELECT trace_id || ':' || concurrency_group AS trace_id, trace_id AS t, concurrency_group, st, en FROM TS WHERE concurrency_group IS NOT NULL), {union('UG', 'G')}, {peak('PG', 'G')},
  M AS (SELECT trace_id AS g, t AS trace_id, concurrency_group, count(*) AS members, CAST(sum(en - st) AS BIGINT) AS summed, max(en) - min(st) AS "window" FROM G GROUP BY ALL)
  SELECT M.trace_id, concurrency_group, members, summed, "window", union_length, summed - union_length AS overlap, peak, CASE WHEN "window" <> 0 THEN summed / "window" ELSE 0.0 END AS ratio FROM M JOIN UG USING (g) JOIN PG USING (g)""")
AGG = f"""{T}, {exclusive('EX', 'TS', 'trace_id', 'category')}, {union('U1', 'TS')}, {union('U2', "(SELECT * FROM TS WHERE outcome <> 'success')")}, {union('U3', '(SELECT * FROM TS WHERE attempt > 1)')},
  AG AS (SELECT RT.trace_id, run_type, scope, batch_id, finalized_at, operation AS root_operation, outcome AS root_outcome, en - st AS makespan, coalesce(U1.union_length, 0) AS covered, coalesce(U2.union_length, 0) AS failed_coverage, coalesce(U3.union_length, 0) AS retry_coverage,
    greatest(en - st - coalesce(U1.union_length, 0), 0) AS unattributed FROM RT LEFT JOIN U1 ON U1.g = trace_id LEFT JOIN U2 ON U2.g = trace_id LEFT JOIN U3 ON U3.g = trace_id)"""
COVER = ", ".join(f"CAST(coalesce(sum(exclusive) FILTER (WHERE label = '{c}'), 0) AS BIGINT) AS {c}_coverage" for c in tr.CATEGORIES)
simple("trace_aggregate", traces, lambda s: tr.aggregate(s).withColumn("slowest", joined("slowest")), f"""WITH {AGG}, CV AS (SELECT g, {COVER} FROM EX GROUP BY g),
  SL AS (SELECT trace_id, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY en - st DESC, span_id) AS slowest FROM (SELECT * FROM TS QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY en - st DESC, span_id) <= 10) GROUP BY 1)
  SELECT AG.*, {', '.join(f'coalesce({c}_coverage, 0) AS {c}_coverage' for c in tr.CATEGORIES)}, slowest FROM AG LEFT JOIN CV ON CV.g = trace_id LEFT JOIN SL USING (trace_id)""")
simple("trace_history", traces, lambda s: tr.history(s, run_type="kickoff", since=1_704_070_000_000_000, recent=20), f"WITH {T} SELECT trace_id, finalized_at, run_type FROM RT WHERE run_type = 'kickoff' AND finalized_at >= 1704070000000000 ORDER BY finalized_at DESC, trace_id DESC LIMIT 20")
simple("trace_history_batch", traces, lambda s: tr.history(s, batch_id="b3"), f"WITH {T} SELECT trace_id, finalized_at, run_type FROM RT WHERE batch_id = 'b3'")
UP = "WITH RECURSIVE {T}, AN AS (SELECT span_id, parent_span_id AS up, 1 AS level FROM TS WHERE category = 'wait' UNION ALL SELECT AN.span_id, TS.parent_span_id, level + 1 FROM AN JOIN TS ON TS.span_id = AN.up WHERE TS.parent_span_id IS NOT NULL)"
NEAR = "NR AS (SELECT AN.span_id, arg_min(up, level) AS ancestor_id, min(level) AS level FROM AN JOIN TS ON TS.span_id = AN.up WHERE TS.category = 'intelligence' GROUP BY AN.span_id)"
simple("nearest_intelligence", traces, lambda s: tr.nearest_ancestor(s, F.col("category") == "wait", "intelligence"), f"{UP.replace('{T}', T)}, {NEAR} SELECT span_id, ancestor_id, CAST(level AS BIGINT) AS level FROM NR")
simple("trace_roles", traces, lambda s: tr.roles(s).select("trace_id", "role", "attempts", "failures", "total", "union", "wait_union", joined("harnesses"), joined("models")), f"""WITH {T}, WK AS (SELECT *, trace_id || ':' || role AS k FROM TS WHERE category = 'intelligence'), WT AS (SELECT w.*, w.trace_id || ':' || w.role AS k FROM TS w JOIN WK ON WK.span_id = w.parent_span_id AND WK.role = w.role WHERE w.category = 'wait'),
  {union('UW', 'WK', 'k')}, {union('UT', 'WT', 'k')}, R AS (SELECT k, trace_id, role, count(*) AS attempts, count(*) FILTER (WHERE outcome <> 'success') AS failures, CAST(sum(en - st) AS BIGINT) AS total, string_agg(DISTINCT harness, ',' ORDER BY harness) AS harnesses, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM WK GROUP BY ALL)
  SELECT trace_id, role, attempts, failures, total, coalesce(UW.union_length, 0) AS "union", coalesce(UT.union_length, 0) AS wait_union, harnesses, models FROM R LEFT JOIN UW ON UW.g = k LEFT JOIN UT ON UT.g = k""")


@query("phase_view", f"""{UP.replace('{T}', T)}, {NEAR}, PS AS (SELECT TS.*, TS.trace_id % 12 AS phase, CASE WHEN NR.span_id IS NOT NULL THEN 'intelligence' ELSE category END AS eff FROM TS LEFT JOIN NR USING (span_id)), MT AS (SELECT * FROM PS WHERE NOT (category = 'wait' AND eff = 'intelligence')),
  {exclusive('EP', 'PS', 'phase', 'eff')}, {union('A1', '(SELECT *, trace_id % 12 AS phase FROM RT)', 'phase')}, {union('A2', 'PS', 'phase')}, {union('A3', "(SELECT * FROM MT WHERE outcome <> 'success')", 'phase')}, {union('A4', '(SELECT * FROM MT WHERE attempt > 1)', 'phase')},
  CV AS (SELECT g, {COVER} FROM EP GROUP BY g), O AS (SELECT trace_id % 12 AS phase, min(st) AS "offset", count(*) AS traces FROM RT GROUP BY 1)
  SELECT phase, "offset", traces, coalesce(A1.union_length, 0) AS active, coalesce(A2.union_length, 0) AS covered, coalesce(A3.union_length, 0) AS failed_coverage, coalesce(A4.union_length, 0) AS retry_coverage, {', '.join(f'coalesce({c}_coverage, 0) AS {c}_coverage' for c in tr.CATEGORIES)}
  FROM O LEFT JOIN A1 ON A1.g = phase LEFT JOIN A2 ON A2.g = phase LEFT JOIN A3 ON A3.g = phase LEFT JOIN A4 ON A4.g = phase LEFT JOIN CV ON CV.g = phase""")
def _phase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.phase_view(traces(spark, sf_dir).withColumn("phase", F.col("trace_id") % 12))


simple("gate_breakdown", traces, tr.gates, f"WITH {T}, GT AS (SELECT * FROM TS WHERE category = 'gate'), {exclusive('EG', 'GT', 'trace_id', 'operation')} SELECT label AS operation, CAST(sum(exclusive) AS BIGINT) AS exclusive FROM EG GROUP BY 1")
simple("slowest_operations", traces, tr.slowest_operations, f"WITH {T} SELECT span_id, operation, en - st AS duration FROM TS ORDER BY duration DESC, operation, span_id LIMIT 20")
X = """XP AS (SELECT user_id AS run_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN user_id + 1000000 ELSE user_id END AS trace_id, CASE user_id % 4 WHEN 0 THEN 'trace-bound' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'finalized' ELSE 'committed' END AS lifecycle_state,
  CASE WHEN user_id % 2 = 0 THEN 'E1' END AS error_code, substr(md5(CAST(user_id % 40 AS VARCHAR)), 1, 8) AS cycle_id, user_id * 1000 AS updated_at FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 < 2)"""
MS = "MS AS (SELECT *, CASE WHEN trace_id IS NULL THEN 'telemetry-init-incomplete' WHEN lifecycle_state IN ('trace-bound', 'incomplete') THEN 'telemetry-finalization-incomplete' ELSE 'persistence-incomplete' END AS state FROM XP WHERE lifecycle_state <> 'finalized')"


@query("managed_reports", f"WITH {T}, {X}, {MS} SELECT RT.trace_id, run_id, state, error_code FROM RT LEFT JOIN MS USING (trace_id)")
def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.managed(tr.roots(traces(spark, sf_dir)), expectations(spark, sf_dir))[0].select("trace_id", "managed_run.run_id", "managed_run.state", "managed_run.error_code")


@query("incomplete_runs", f"WITH {T}, {X}, {MS} SELECT run_id, state, error_code FROM MS WHERE trace_id IS NULL OR trace_id NOT IN (SELECT trace_id FROM RT)")
def _incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.managed(tr.roots(traces(spark, sf_dir)), expectations(spark, sf_dir))[1].select("run_id", "state", "error_code")


@query("recent_reports", f"""WITH {T}, {X}, {MS}, B AS (SELECT finalized_at AS stamp, CAST(trace_id AS VARCHAR) AS id, 'report' AS kind FROM RT UNION ALL SELECT updated_at, CAST(run_id AS VARCHAR), 'incomplete' FROM MS WHERE trace_id IS NULL OR trace_id NOT IN (SELECT trace_id FROM RT))
  SELECT * FROM B ORDER BY stamp DESC, id DESC, kind DESC LIMIT 30""")
def _recent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, missing = tr.managed(tr.roots(traces(spark, sf_dir)), expectations(spark, sf_dir))
    return tr.recent_window(reports, missing, 30)


@query("checkpoint_links", f"""WITH {T}, {X}, RP AS (SELECT *, en - st AS makespan FROM RT), OU AS (SELECT trace_id AS outer_trace_id, batch_id, makespan AS outer_makespan FROM RP WHERE run_type = 'checkpoint'),
  LK AS (SELECT OU.outer_trace_id, RP.trace_id, RP.makespan FROM OU JOIN RP USING (batch_id) WHERE scope = 'project' AND trace_id <> outer_trace_id), RN AS (SELECT DISTINCT outer_trace_id, cycle_id FROM LK JOIN XP USING (trace_id)),
  NM AS (SELECT DISTINCT trace_id AS outer_trace_id, substr(operation, 18) AS cycle_id FROM CH WHERE run_type = 'checkpoint' AND starts_with(operation, 'checkpoint.cycle.')), MI AS (SELECT outer_trace_id, string_agg(cycle_id, ',' ORDER BY cycle_id) AS missing_cycles FROM (SELECT * FROM NM EXCEPT SELECT * FROM RN) GROUP BY 1),
  SU AS (SELECT outer_trace_id, count(*) AS children, CAST(sum(makespan) AS BIGINT) AS child_work FROM LK GROUP BY 1)
  SELECT outer_trace_id, batch_id, outer_makespan, coalesce(children, 0) AS children, coalesce(child_work, 0) AS child_work, coalesce(missing_cycles, '') AS missing_cycles FROM OU LEFT JOIN SU USING (outer_trace_id) LEFT JOIN MI USING (outer_trace_id)""")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces(spark, sf_dir)
    reports = tr.roots(spans).withColumn("makespan", tr.length())
    return tr.checkpoint_links(reports, spans, expectations(spark, sf_dir)).withColumn("missing_cycles", joined("missing_cycles"))


@query("finalise_new", f"WITH {T} SELECT trace_id, count(*) + 1 AS spans FROM TS WHERE trace_id % 5 = 4 GROUP BY 1")
def _finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces(spark, sf_dir)
    return tr.finalised(spans.filter("trace_id % 5 < 4"), spans.filter("trace_id % 5 > 1")).groupBy("trace_id").agg(F.count("*").alias("spans"))


@query("recovered_spans", f"WITH {T} SELECT span_id, outcome, en FROM (SELECT span_id, CASE WHEN span_id % 9 = 0 THEN 'interrupted' ELSE outcome END AS outcome, CASE WHEN span_id % 9 = 0 THEN greatest(st, 1706000000000000) ELSE en END AS en FROM TS UNION ALL SELECT span_id, CASE WHEN trace_id % 2 = 0 THEN 'interrupted' ELSE outcome END, CASE WHEN trace_id % 2 = 0 THEN greatest(st, 1706000000000000) ELSE en END FROM RT)")
def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces(spark, sf_dir)
    is_open = F.when(F.col("parent_span_id").isNull(), F.col("trace_id") % 2 == 0).otherwise(F.col("span_id") % 9 == 0)
    return tr.recovered(spans.withColumn("en", F.when(~is_open, F.col("en"))), 1_706_000_000_000_000).select("span_id", "outcome", "en")


@query("reconciled_runs", f"WITH {T}, {X} SELECT run_id, CASE WHEN trace_id IN (SELECT trace_id FROM RT) THEN 'finalized' ELSE lifecycle_state END AS lifecycle_state FROM XP")
def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.reconciled(expectations(spark, sf_dir), traces(spark, sf_dir)).select("run_id", "lifecycle_state")


PAY = f"""{T}, {union('UF', "(SELECT * FROM TS WHERE outcome <> 'success')")}, KO AS (SELECT RT.*, substr(operation, 7) AS phase, coalesce(union_length, 0) AS failed FROM RT LEFT JOIN UF ON UF.g = trace_id WHERE run_type = 'kickoff'),
  AC AS (SELECT phase, trace_id AS accepted_trace_id, finalized_at AS accepted_at FROM KO WHERE outcome = 'success' AND trace_id = (SELECT max(trace_id) FROM KO k WHERE k.phase = KO.phase)),
  PP AS (SELECT KO.phase, trace_id, finalized_at, CASE WHEN trace_id = accepted_trace_id THEN 'accepted' WHEN outcome <> 'success' OR failed > 0 THEN 'unsuccessful' ELSE 'superseded' END AS status, finalized_at <= accepted_at AS in_lineage FROM KO JOIN AC USING (phase))"""


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces(spark, sf_dir)
    last = tr.roots(spans).filter("run_type = 'kickoff'").groupBy(F.regexp_extract("operation", r"^phase\.(.*)$", 1).alias("phase")).agg(F.max("trace_id").alias("accepted_trace_id"))
    return tr.phase_payload(spans, last)


query("phase_payload", f"WITH {PAY} SELECT * FROM PP")(payload)


@query("phases_by_day", f"WITH {PAY} SELECT finalized_at // 86400000000 AS day, string_agg(phase, ',' ORDER BY phase) AS phases FROM PP WHERE status = 'accepted' GROUP BY 1")
def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.dates(payload(spark, sf_dir), F.floor(F.col("finalized_at") / 86_400_000_000)).withColumn("phases", joined("phases"))


@query("trace_errors", f"""WITH {T}, AL AS (SELECT trace_id, span_id, parent_span_id, category, attempt, outcome, st, en FROM TS UNION ALL SELECT trace_id, span_id, NULL, 'run', 1, outcome, st, en FROM RT),
  B AS (SELECT trace_id, span_id, CASE WHEN span_id % 101 = 7 THEN 99999999 ELSE parent_span_id END AS parent_span_id, category, CASE WHEN span_id % 89 = 5 THEN 0 ELSE attempt END AS attempt, outcome, CASE WHEN outcome = 'success' AND span_id % 13 <> 1 THEN 0 ELSE 1 END AS code, st, en FROM AL),
  RE AS (SELECT a.span_id FROM B a LEFT JOIN B b ON b.span_id = a.parent_span_id LEFT JOIN B c ON c.span_id = b.parent_span_id LEFT JOIN B d ON d.span_id = c.parent_span_id WHERE a.parent_span_id IS NULL OR (b.span_id IS NOT NULL AND (b.parent_span_id IS NULL OR (c.span_id IS NOT NULL AND (c.parent_span_id IS NULL OR d.span_id IS NOT NULL))))),
  V AS (SELECT B.trace_id, B.span_id, concat_ws(',', CASE WHEN B.attempt < 1 THEN 'attempt' END, CASE WHEN B.parent_span_id IS NOT NULL AND p.span_id IS NULL THEN 'parent-missing' END, CASE WHEN B.st < p.st OR B.en > p.en THEN 'outside-parent' END, CASE WHEN B.span_id NOT IN (SELECT span_id FROM RE) THEN 'unreachable' END, CASE WHEN B.outcome = 'success' AND B.code <> 0 THEN 'exit-code' END) AS errors
    FROM B LEFT JOIN B p ON p.span_id = B.parent_span_id) SELECT * FROM V WHERE errors <> ''""")
def _trace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces(spark, sf_dir)
    odd = spans.withColumn("parent_span_id", F.when(F.col("span_id") % 101 == 7, F.lit(99_999_999)).otherwise(F.col("parent_span_id"))).withColumn("attempt", F.when(F.col("span_id") % 89 == 5, 0).otherwise(F.col("attempt")))
    return tr.errors(odd.withColumn("exit_code", F.when((F.col("outcome") == "success") & (F.col("span_id") % 13 != 1), 0).otherwise(1)))
