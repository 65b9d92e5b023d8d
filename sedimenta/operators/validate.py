"""Validators: each record's errors, and a sequence's."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.scalars import instant
from sedimenta.schemas import CAS_ID, EVENT_ID, JOURNAL, JOURNAL_SCHEMA, V1_JOURNAL


def _errors(rules: dict[str, Column]) -> Column:
    """The codes of the rules that hold; a rule that is NULL (its field is missing) counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(code)) for code, rule in rules.items())))


def key_errors(line: Column, declared: list[str]) -> Column:
    """closed schema: the keys of a JSON text must be the declared ones, each once; a line that is no object has NULL keys."""
    keys = F.json_object_keys(line)
    return F.when(keys.isNull(), F.lit("not-an-object")).when(F.size(keys) != F.size(F.array_distinct(keys)), F.lit("duplicate-key")).when(F.array_sort(keys) != F.array(*map(F.lit, sorted(declared))), F.lit("keys"))


def _shared_rules() -> dict[str, Column]:
    path = F.col("original_relpath")
    return {
        "event": F.col("event") != "ingest",
        "outcome": ~F.col("outcome").isin("stored", "dedup"),
        "cas-id": ~F.col("cas_id").rlike(CAS_ID),
        "size": F.col("size") < 0,
        "media-type": F.col("media_type") == "",
        "source": F.col("source_root_id") == "",
        "time": instant(F.col("at")).isNull(),
        "relpath": (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), ".."),
    }


def v1_record_errors(records: DataFrame) -> DataFrame:
    """ord, errors of ten-field records of the first format (V1_JOURNAL): as for records of today, and mtime must not be empty."""
    rules = _shared_rules() | {"mtime": F.col("mtime") == ""}
    return records.select("ord", F.array_join(_errors(rules), ",").alias("errors")).filter("errors <> ''")


def parsed_v1(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: ord, line. (records, errors) of a journal of the first format. Identity of today's format refuses at once:
    migration is done only once."""
    keys = F.json_object_keys("line")
    already = F.coalesce(F.array_contains(keys, "schema") | F.array_contains(keys, "event_id"), F.lit(False))
    keyed = lines.withColumn("key_error", F.when(already, F.lit("already-migrated")).otherwise(key_errors(F.col("line"), V1_JOURNAL.fieldNames())))
    keyed = keyed.withColumn("key_error", F.coalesce("key_error", F.when(_not_an_integer("$.size"), F.lit("size"))))
    records = keyed.filter("key_error IS NULL").select("ord", F.from_json("line", V1_JOURNAL).alias("r")).select("ord", "r.*")
    errors = keyed.filter("key_error IS NOT NULL").select("ord", F.col("key_error").alias("errors"))
    return records, errors.unionByName(v1_record_errors(records))


def record_errors(journal: DataFrame) -> DataFrame:
    """event_id, errors: codes joined by commas, for records with any."""
    rules = {"schema": F.col("schema") != JOURNAL_SCHEMA, "event-id": ~F.col("event_id").rlike(EVENT_ID)} | _shared_rules()
    return journal.select("ord", "event_id", F.array_join(_errors(rules), ",").alias("errors")).filter("errors <> ''")


def sequence_errors(journal: DataFrame) -> DataFrame:
    """Repeated event ids, and records before the one they follow, by (instant, event_id)."""
    key = F.struct(instant(F.col("at")).alias("t"), F.col("event_id"))
    rows = journal.select("ord", "event_id", key.alias("key"))
    # the previous record by ord: ranges of ord overlap by one row, so no task orders the whole journal
    marked = rows.withColumn("n", F.count("*").over(Window.partitionBy("event_id"))).withColumn("part", F.floor(F.col("ord") / 65536))
    before = F.lag("key").over(Window.partitionBy("part").orderBy("ord"))
    last = marked.groupBy("part").agg(F.max_by("key", "ord").alias("edge")).withColumn("next", F.lead("part").over(Window.orderBy("part")))
    edges = last.filter("next IS NOT NULL").select(F.col("next").alias("part"), "edge")
    joined = marked.withColumn("before", before).join(edges, "part", "left").withColumn("before", F.coalesce("before", "edge"))
    fault = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("repeated")), F.when(F.col("key") < F.col("before"), F.lit("order"))))
    return joined.select("ord", "event_id", F.array_join(fault, ",").alias("errors")).filter("errors <> ''")


def _not_an_integer(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), path, "variant")) != "BIGINT", F.lit(True))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: ord, line. (records, errors) of a strict journal: closed keys, then fields, then the grammars."""
    keyed = lines.withColumn("key_error", key_errors(F.col("line"), JOURNAL.fieldNames()))
    keyed = keyed.withColumn("key_error", F.coalesce("key_error", F.when(_not_an_integer("$.size"), F.lit("size"))))
    records = keyed.filter("key_error IS NULL").select("ord", F.from_json("line", JOURNAL).alias("r")).select("ord", "r.*")
    errors = keyed.filter("key_error IS NOT NULL").select("ord", F.lit(None).cast("string").alias("event_id"), F.col("key_error").alias("errors"))
    return records, errors.unionByName(record_errors(records))


def span_errors(spans: DataFrame) -> DataFrame:
    """Spans (trace_id, span_id, parent_span_id, st, en, duration) that contradict themselves or their parents."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("st").alias("p_st"), F.col("en").alias("p_en"))
    joined = spans.join(parents, ["trace_id", "parent_span_id"], "left")
    roots = F.count_if(F.col("parent_span_id").isNull()).over(Window.partitionBy("trace_id"))
    child = F.col("parent_span_id").isNotNull()
    fault = F.array_compact(
        F.array(
            F.when(F.col("duration") != F.col("en") - F.col("st"), F.lit("duration")),
            F.when(F.col("en") < F.col("st"), F.lit("ends-before-start")),
            F.when(child & F.col("p_st").isNull(), F.lit("parent-missing")),
            F.when((F.col("st") < F.col("p_st")) | (F.col("en") > F.col("p_en")), F.lit("outside-parent")),
            F.when(F.col("roots") != 1, F.lit("roots")),
        )
    )
    return joined.withColumn("roots", roots).select("trace_id", "span_id", F.array_join(fault, ",").alias("errors")).filter("errors <> ''")
