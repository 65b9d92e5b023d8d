"""Traces: trees of timed spans, one root each, and the reports over them.

spans: trace_id, span_id (unique over all traces), parent_span_id, category, operation, attempt, outcome, st, en, and the
root's run_type, scope, batch_id, finalized_at, repeated on each of its spans; the rest may be NULL.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators import intervals
from sedimenta.operators.tree import ancestors, ascents

CATEGORIES = ("gate", "intelligence", "reconciliation", "wait")
MEMBER = r"^role\.cycle\.([0-9a-f]{8})$"


class Conflict(ValueError):
    """A trace that the ledger holds with other spans."""


def length() -> Column:
    return F.col("en") - F.col("st")


def roots(spans: DataFrame) -> DataFrame:
    return spans.filter("parent_span_id IS NULL")


def children(spans: DataFrame) -> DataFrame:
    return spans.filter("parent_span_id IS NOT NULL")


def with_depth(spans: DataFrame) -> DataFrame:
    """spans that reach a root, with their number of steps to it."""
    edges = spans.select(F.col("span_id").alias("entry_id"), F.col("parent_span_id").alias("up"), F.lit("").alias("path"))
    return spans.drop("depth").join(ascents(edges).select(F.col("entry_id").alias("span_id"), F.col("hops").alias("depth")), "span_id")


def errors(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, errors: what a trace's rules refuse. Optional columns: exit_code, timeout_kind, timeout, position (in the file)."""
    has = lambda c: F.col(c) if c in spans.columns else F.lit(None)
    parents = spans.select(F.col("span_id").alias("parent_span_id"), F.col("trace_id").alias("p_trace"), F.col("st").alias("p_st"), F.col("en").alias("p_en"))
    reached = with_depth(spans).select("span_id", F.lit(True).alias("reached"))
    by_trace = Window.partitionBy("trace_id")
    rows = spans.join(parents, "parent_span_id", "left").join(reached, "span_id", "left")
    rows = rows.withColumn("__roots", F.count_if(F.col("parent_span_id").isNull()).over(by_trace)).withColumn("__ids", F.count("*").over(Window.partitionBy("span_id")))
    rows = rows.withColumn("__rank", F.row_number().over(by_trace.orderBy("st", "span_id")))
    child, code, outcome = F.col("parent_span_id").isNotNull(), has("exit_code").cast("int"), F.col("outcome")
    kind, limit = has("timeout_kind"), has("timeout").cast("bigint")
    rules = {
        "ends-before-start": F.col("en") < F.col("st"),
        "repeated": F.col("__ids") > 1,
        "roots": F.col("__roots") != 1,
        "root-category": ~child & (F.col("category") != "run"),
        "run-category": child & (F.col("category") == "run"),
        "category": ~F.col("category").isin("run", *CATEGORIES),
        "attempt": F.col("attempt") < 1,
        "parent-missing": child & (F.col("p_trace").isNull() | (F.col("p_trace") != F.col("trace_id"))),
        "outside-parent": (F.col("st") < F.col("p_st")) | (F.col("en") > F.col("p_en")),
        "unreachable": F.col("reached").isNull(),
        "exit-code": ((outcome == "success") & (code != 0)) | ((outcome == "error") & (code == 0)) | ((outcome == "timeout") & (code != 124)) | (outcome.isin("cancelled", "interrupted") & (code == 0)),
        "timeout": F.when(outcome == "timeout", kind.isNull() | F.coalesce(limit < 1, F.lit(True))).otherwise(kind.isNotNull() | limit.isNotNull()) if "timeout_kind" in spans.columns else F.lit(False),
        "order": has("position") != F.col("__rank"),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select("trace_id", "span_id", F.array_join(found, ",").alias("errors")).filter("errors <> ''")


def batch_metrics(spans: DataFrame) -> DataFrame:
    """Measures of each trace that is an improve-batch: members are the cycles of its intelligence spans."""
    own = children(spans.filter("run_type = 'improve-batch'"))
    members = own.filter("category = 'intelligence'").withColumn("cycle", F.regexp_extract("operation", MEMBER, 1)).filter("cycle <> ''")
    after = lambda prefix: F.when(F.startswith("operation", F.lit(prefix)), F.substr("operation", F.lit(len(prefix) + 1)))
    committed = own.filter("outcome = 'success'").select("trace_id", after("batch.commit.").alias("cycle")).filter("cycle IS NOT NULL").distinct().withColumn("committed", F.lit(True))
    by_cycle = members.groupBy("trace_id", "cycle").agg(F.count("*").alias("n"), F.sum(length()).alias("work"), F.max("attempt").alias("most"), F.max(F.col("outcome") == "success").alias("ok"))
    by_cycle = by_cycle.join(committed, ["trace_id", "cycle"], "left").groupBy("trace_id").agg(
        F.count("*").alias("launched_members"),
        F.count_if(~F.col("ok")).alias("failed_members"),
        F.count_if((F.col("n") > 1) | (F.col("most") > 1)).alias("retried_members"),
        F.sum("work").alias("summed_member_work"),
        F.coalesce(F.sum(F.when(F.col("committed"), F.col("work"))), F.lit(0)).alias("committed_member_work"),
    )
    told = own.groupBy("trace_id").agg(F.count_distinct(F.when(F.col("outcome") == "success", after("batch.commit."))).alias("committed_members"), F.count_distinct(after("batch.quarantine.")).alias("quarantined_members"), F.count_distinct(after("batch.telemetry-incomplete.")).alias("telemetry_incomplete_members"))
    window = members.groupBy("trace_id").agg((F.max("en") - F.min("st")).alias("member_window"))
    union = intervals.union_length(members, "trace_id").select("trace_id", F.col("union_length").alias("member_active_union"))
    peak = intervals.peak_concurrency(members, "trace_id").select("trace_id", F.col("peak").alias("peak_concurrency"))
    rows = roots(spans.filter("run_type = 'improve-batch'")).select("trace_id", length().alias("batch_makespan"))
    for more in (told, by_cycle, window, union, peak):
        rows = rows.join(more, "trace_id", "left")
    counted = [c for c in rows.columns if c not in ("trace_id", "batch_makespan")]
    rows = rows.fillna(0, counted)
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return rows.select(
        "*",
        (F.col("summed_member_work") - F.col("member_active_union")).alias("overlap"),
        F.floor(F.col("batch_makespan") / nonzero("committed_members")).alias("makespan_per_committed"),
        F.when(F.col("committed_members") == 0, "no committed members").alias("makespan_per_committed_reason"),
        (F.col("summed_member_work") / nonzero("member_window")).alias("work_to_window_ratio"),
        (F.col("committed_member_work") / nonzero("batch_makespan")).alias("observed_speedup"),
        F.when(F.col("batch_makespan") == 0, "zero batch makespan").alias("observed_speedup_reason"),
    )


def token_references(spans: DataFrame) -> DataFrame:
    """The sorted spans of each (trace, ledger, cycle, role) that a token reference names."""
    named = spans.filter("token_ledger IS NOT NULL")
    return named.groupBy("trace_id", "token_ledger", "token_cycle", "token_role").agg(F.array_sort(F.collect_list("span_id")).alias("span_ids"))


def concurrency_groups(spans: DataFrame) -> DataFrame:
    own = children(spans).filter("concurrency_group IS NOT NULL").withColumn("__group", F.struct("trace_id", "concurrency_group"))
    window = own.groupBy("__group").agg(F.count("*").alias("members"), F.sum(length()).alias("summed"), (F.max("en") - F.min("st")).alias("window"))
    joined = window.join(intervals.union_length(own, "__group").drop("islands"), "__group").join(intervals.peak_concurrency(own, "__group"), "__group")
    ratio = F.when(F.col("window") != 0, F.col("summed") / F.col("window")).otherwise(F.lit(0.0))
    return joined.select("__group.*", "members", "summed", "window", "union_length", (F.col("summed") - F.col("union_length")).alias("overlap"), "peak", ratio.alias("ratio"))


def aggregate(spans: DataFrame) -> DataFrame:
    """A row per trace: makespan, coverage (all, failed, repeated, exclusive by category), and the ten slowest spans' ids."""
    own = with_depth(children(spans.drop("depth")).unionByName(roots(spans.drop("depth")))).filter("parent_span_id IS NOT NULL")
    exclusive = intervals.exclusive(own, "trace_id").groupBy("trace_id").agg(*(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("exclusive"))), F.lit(0)).alias(f"{c}_coverage") for c in CATEGORIES))
    rows = roots(spans).select("trace_id", "run_type", "scope", "batch_id", "finalized_at", F.col("operation").alias("root_operation"), F.col("outcome").alias("root_outcome"), length().alias("makespan"))
    parts = {"covered": children(spans), "failed_coverage": children(spans).filter("outcome <> 'success'"), "retry_coverage": children(spans).filter("attempt > 1")}
    for name, part in parts.items():
        rows = rows.join(intervals.union_length(part, "trace_id").select("trace_id", F.col("union_length").alias(name)), "trace_id", "left")
    order = Window.partitionBy("trace_id").orderBy(length().desc(), "span_id")
    slow = children(spans).withColumn("rn", F.row_number().over(order)).filter("rn <= 10").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "span_id"))), lambda x: x["span_id"]).alias("slowest"))
    rows = rows.join(exclusive, "trace_id", "left").join(slow, "trace_id", "left").fillna(0, [*parts, *(f"{c}_coverage" for c in CATEGORIES)])
    return rows.withColumn("unattributed", F.greatest(F.col("makespan") - F.col("covered"), F.lit(0)))


def history(spans: DataFrame, trace_id=None, run_type: str | None = None, batch_id: str | None = None, phase_id: str | None = None, since=None, recent: int | None = None) -> DataFrame:
    """The traces (trace_id, finalized_at, run_type) that pass all filters, oldest first; `recent` keeps the last so many."""
    if phase_id is not None and (run_type not in (None, "kickoff") or batch_id is not None):
        raise ValueError("a phase goes with run type kickoff and no batch")
    rows = roots(spans)
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    if run_type is not None:
        rows = rows.filter(F.col("run_type") == run_type)
    if phase_id is not None:
        rows = rows.filter((F.col("run_type") == "kickoff") & (F.col("operation") == f"phase.{phase_id}"))
    if since is not None:
        rows = rows.filter(F.col("finalized_at") >= since)
    if batch_id is not None:
        rows = rows.join(spans.filter(F.col("batch_id") == batch_id).select("trace_id").distinct(), "trace_id", "left_semi")
    rows = rows.select("trace_id", "finalized_at", "run_type")
    if recent is not None:
        rows = rows.orderBy(F.col("finalized_at").desc(), F.col("trace_id").desc()).limit(recent)
    return rows.orderBy("finalized_at", "trace_id")


def nearest_ancestor(spans: DataFrame, of: Column, category: str) -> DataFrame:
    """For each span that satisfies `of` and stands below one of the category: span_id, ancestor_id, level of the nearest."""
    entries = spans.select(F.col("span_id").alias("entry_id"), F.col("parent_span_id").alias("parent_id"))
    up = ancestors(entries, spans.filter(of).select(F.col("span_id").alias("entry_id"))).filter("level > 0")
    named = spans.filter(F.col("category") == category).select(F.col("span_id").alias("ancestor_id"))
    nearest = up.join(named, "ancestor_id", "left_semi").groupBy("entry_id").agg(F.min(F.struct("level", "ancestor_id")).alias("a"))
    return nearest.select(F.col("entry_id").alias("span_id"), "a.ancestor_id", "a.level")


def with_effective_category(spans: DataFrame) -> DataFrame:
    """A wait below an intelligence span counts as intelligence."""
    below = nearest_ancestor(spans, F.col("category") == "wait", "intelligence").select("span_id", F.lit(True).alias("__below"))
    return spans.join(below, "span_id", "left").withColumn("effective_category", F.when(F.col("__below"), "intelligence").otherwise(F.col("category"))).drop("__below")


def roles(spans: DataFrame) -> DataFrame:
    """A row per trace and role of its intelligence spans: attempts, failures, time, union, union of the waits right below them, harnesses, models."""
    own = children(spans)
    work = own.filter("category = 'intelligence' AND role IS NOT NULL")
    sums = work.groupBy("trace_id", "role").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") != "success").alias("failures"), F.sum(length()).alias("total"), F.array_sort(F.collect_set("harness")).alias("harnesses"), F.array_sort(F.collect_set("model")).alias("models"))
    above = work.select(F.col("span_id").alias("parent_span_id"), "role")
    waits = own.filter("category = 'wait'").join(above, ["parent_span_id", "role"], "left_semi")
    for name, rows in (("union", work), ("wait_union", waits)):
        keyed = rows.withColumn("__key", F.struct("trace_id", "role"))
        sums = sums.join(intervals.union_length(keyed, "__key").select("__key.*", F.col("union_length").alias(name)), ["trace_id", "role"], "left")
    return sums.fillna(0, ["union", "wait_union"])


def phase_view(spans: DataFrame, by: str = "phase") -> DataFrame:
    """A row per group of traces (column `by`): times of several traces on one clock, categories with waits folded in.

    st and en are instants here, so traces of one group lie on one axis; offset is where a group begins.
    """
    rows = with_effective_category(spans)
    own = with_depth(rows).filter("parent_span_id IS NOT NULL")
    inside = intervals.exclusive(own, by, "effective_category").groupBy(by).agg(*(F.coalesce(F.sum(F.when(F.col("effective_category") == c, F.col("exclusive"))), F.lit(0)).alias(f"{c}_coverage") for c in CATEGORIES))
    out = roots(spans).groupBy(by).agg(F.min("st").alias("offset"), F.count("*").alias("traces"))
    material = children(rows).filter("NOT (category = 'wait' AND effective_category = 'intelligence')")
    parts = {"active": roots(spans), "covered": children(rows), "failed_coverage": material.filter("outcome <> 'success'"), "retry_coverage": material.filter("attempt > 1")}
    for name, part in parts.items():
        out = out.join(intervals.union_length(part, by).select(by, F.col("union_length").alias(name)), by, "left")
    return out.join(inside, by, "left").fillna(0, [*parts, *(f"{c}_coverage" for c in CATEGORIES)])


def gates(spans: DataFrame) -> DataFrame:
    """Exclusive time of gate spans by operation, the longest first; only gates compete for a segment."""
    own = with_depth(spans).filter("category = 'gate'")
    return intervals.exclusive(own, "trace_id", "operation").groupBy("operation").agg(F.sum("exclusive").alias("exclusive")).orderBy(F.col("exclusive").desc(), "operation")


def slowest_operations(spans: DataFrame, n: int = 20) -> DataFrame:
    return children(spans).select("span_id", "operation", length().alias("duration")).orderBy(F.col("duration").desc(), "operation", "span_id").limit(n)


def managed_state(expectations: DataFrame) -> DataFrame:
    """Expected runs that are not done, with the state that a report names."""
    state = F.when(F.col("trace_id").isNull(), "telemetry-init-incomplete").when(F.col("lifecycle_state").isin("trace-bound", "incomplete"), "telemetry-finalization-incomplete").otherwise("persistence-incomplete")
    return expectations.filter("lifecycle_state <> 'finalized'").withColumn("state", state)


def managed(reports: DataFrame, expectations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports with the first expected run of their trace, expected runs without a report)."""
    open_ = managed_state(expectations)
    first = open_.filter("trace_id IS NOT NULL").groupBy("trace_id").agg(F.min_by(F.struct("run_id", "state", "error_code"), "run_id").alias("managed_run"))
    missing = open_.join(reports.select("trace_id").distinct(), "trace_id", "left_anti")
    return reports.join(first, "trace_id", "left"), missing


def recent_window(reports: DataFrame, missing: DataFrame, n: int) -> DataFrame:
    """The n latest of reports and missing runs together (stamp, id, kind), oldest first."""
    both = reports.select(F.col("finalized_at").alias("stamp"), F.col("trace_id").cast("string").alias("id"), F.lit("report").alias("kind"))
    both = both.unionByName(missing.select(F.col("updated_at").alias("stamp"), F.col("run_id").cast("string").alias("id"), F.lit("incomplete").alias("kind")))
    return both.orderBy(F.col("stamp").desc(), F.col("id").desc(), F.col("kind").desc()).limit(n).orderBy("stamp", "id", "kind")


def checkpoint_links(reports: DataFrame, spans: DataFrame, expectations: DataFrame) -> DataFrame:
    """Each checkpoint trace with the project traces of its batch: their number and work, and the cycles it names that none of them ran."""
    outer = reports.filter("run_type = 'checkpoint' AND batch_id IS NOT NULL").select(F.col("trace_id").alias("outer_trace_id"), "batch_id", F.col("makespan").alias("outer_makespan"))
    inner = reports.filter("scope = 'project'").select("trace_id", "batch_id", "makespan")
    linked = outer.join(inner, "batch_id").filter("trace_id <> outer_trace_id")
    cycles = expectations.filter("trace_id IS NOT NULL AND cycle_id IS NOT NULL").select("trace_id", "cycle_id").distinct()
    ran = linked.join(cycles, "trace_id").select("outer_trace_id", "cycle_id").distinct()
    named = children(spans).filter("run_type = 'checkpoint'").select(F.col("trace_id").alias("outer_trace_id"), F.regexp_extract("operation", r"^checkpoint\.cycle\.(.*)$", 1).alias("cycle_id")).filter("cycle_id <> ''").distinct()
    missing = named.join(ran, ["outer_trace_id", "cycle_id"], "left_anti").groupBy("outer_trace_id").agg(F.array_sort(F.collect_list("cycle_id")).alias("missing_cycles"))
    sums = linked.groupBy("outer_trace_id").agg(F.count("*").alias("children"), F.sum("makespan").alias("child_work"))
    out = outer.join(sums, "outer_trace_id", "left").join(missing, "outer_trace_id", "left").fillna(0, ["children", "child_work"])
    return out.withColumn("missing_cycles", F.coalesce("missing_cycles", F.array().cast("array<string>")))


def cross_scope(ledgers: dict[str, DataFrame], expectations: DataFrame, recent: int | None = None) -> dict[str, DataFrame]:
    """The report over several ledgers of spans: reports, incomplete runs, repeated traces, checkpoint links, the latest of all."""
    spans = None
    for name, rows in sorted(ledgers.items()):
        rows = rows.withColumn("ledger", F.lit(name))
        spans = rows if spans is None else spans.unionByName(rows, allowMissingColumns=True)
    repeated = roots(spans).groupBy("trace_id").agg(F.array_sort(F.collect_list("ledger")).alias("ledgers")).filter("size(ledgers) > 1")
    reports, missing = managed(aggregate(spans), expectations)
    out = {"reports": reports, "incomplete": missing, "diagnostics": repeated, "links": checkpoint_links(reports, spans, expectations)}
    if recent is not None:
        out["window"] = recent_window(reports, missing, recent)
    return out


def finalised(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates' spans that the ledger lacks. A trace it holds with the same spans is done already; with others it is a conflict."""
    columns = candidates.columns
    both = candidates.withColumn("__d", F.lit(1)).unionByName(ledger.select(columns).withColumn("__d", F.lit(-1)))
    differing = both.groupBy(*columns).agg(F.sum("__d").alias("__d")).groupBy("trace_id").agg(F.max(F.col("__d") != 0).alias("differs"))
    held, asked = (rows.select("trace_id").distinct() for rows in (ledger, candidates))
    odd = differing.filter("differs").join(held, "trace_id", "left_semi").join(asked, "trace_id", "left_semi").select("trace_id")
    if found := odd.limit(5).collect():
        raise Conflict(f"held with other spans: {sorted(r[0] for r in found)}")
    return candidates.join(ledger.select("trace_id").distinct(), "trace_id", "left_anti")


def recovered(spans: DataFrame, now: int) -> DataFrame:
    """Open spans (en NULL) closed as interrupted at `now`. All leaves close at one sampled time, so their parents do as well;
    an open span whose way up ends nowhere cannot be closed and is refused."""
    open_ = spans.filter("en IS NULL")
    if not open_.join(with_depth(spans).select("span_id"), "span_id", "left_anti").isEmpty():
        raise Conflict("open spans that reach no root")
    is_open = F.col("en").isNull()
    return spans.withColumn("outcome", F.when(is_open, "interrupted").otherwise(F.col("outcome"))).withColumn("en", F.coalesce("en", F.greatest(F.col("st"), F.lit(now))))


def reconciled(expectations: DataFrame, spans: DataFrame) -> DataFrame:
    """Expected runs whose trace is in the ledger become finalized; others stay."""
    done = roots(spans).select("trace_id", F.lit(True).alias("__done")).distinct()
    return expectations.join(done, "trace_id", "left").withColumn("lifecycle_state", F.when(F.col("__done"), "finalized").otherwise(F.col("lifecycle_state"))).drop("__done")


def phase_payload(spans: DataFrame, accepted: DataFrame) -> DataFrame:
    """The kickoff traces of each phase beside its accepted one (phase, accepted_trace_id): status, and whether they are in its lineage."""
    failed = intervals.union_length(children(spans).filter("outcome <> 'success'"), "trace_id").select("trace_id", F.col("union_length").alias("failed"))
    own = roots(spans).filter("run_type = 'kickoff'").withColumn("phase", F.regexp_extract("operation", r"^phase\.(.*)$", 1)).join(failed, "trace_id", "left")
    chosen = own.join(accepted.select(F.col("phase"), F.col("accepted_trace_id").alias("trace_id")), ["phase", "trace_id"], "left_semi").filter("outcome = 'success'").select("phase", F.col("trace_id").alias("accepted_trace_id"), F.col("finalized_at").alias("accepted_at"))
    joined = own.join(chosen, "phase")
    is_accepted = F.col("trace_id") == F.col("accepted_trace_id")
    status = F.when(is_accepted, "accepted").when((F.col("outcome") != "success") | (F.coalesce("failed", F.lit(0)) > 0), "unsuccessful").otherwise("superseded")
    return joined.select("phase", "trace_id", "finalized_at", status.alias("status"), (F.col("finalized_at") <= F.col("accepted_at")).alias("in_lineage"))


def dates(payload: DataFrame, day: Column) -> DataFrame:
    """The accepted phases of each day, the latest day first."""
    return payload.filter("status = 'accepted'").groupBy(day.alias("day")).agg(F.array_sort(F.collect_list("phase")).alias("phases")).orderBy(F.col("day").desc())


def text_report(reports: DataFrame, n: int = 50) -> str:
    """The last n reports as a table of text, for a person to read."""
    lines = [f"{'trace':<12}{'run type':<16}{'makespan':>16}{'covered':>16}{'failed':>16}"]
    for r in reports.orderBy(F.col("finalized_at").desc(), "trace_id").limit(n).collect():
        lines.append(f"{r['trace_id']!s:<12}{r['run_type']:<16}{r['makespan']:>16}{r['covered']:>16}{r['failed_coverage']:>16}")
    return "\n".join(lines) + "\n"
