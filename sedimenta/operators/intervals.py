"""Interval analytics over spans: unions, concurrency, attribution, parks."""

import heapq
from collections.abc import Iterable, Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def union_length(spans: DataFrame, by: str = "g", bucket: int | None = None) -> DataFrame:
    """The length of the union of each group's intervals; touching intervals merge.

    With a bucket (a length of time), intervals are cut at its multiples first and each (group, bucket) is worked on by
    itself, so that a few large groups are spread over tasks; the length is the same, islands are not told.
    """
    if bucket:
        placed = spans.select(by, "st", "en", F.explode(F.sequence(F.floor(F.col("st") / bucket), F.floor(F.greatest(F.col("en") - 1, F.col("st")) / bucket))).alias("__bucket"))
        cut = placed.select(F.struct(by, "__bucket").alias("__key"), F.greatest("st", F.col("__bucket") * bucket).alias("st"), F.least("en", (F.col("__bucket") + 1) * bucket).alias("en"))
        return union_length(cut, "__key").groupBy(F.col(f"__key.{by}").alias(by)).agg(F.sum("union_length").alias("union_length"))
    earlier = Window.partitionBy(by).orderBy("st", "en").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("st", "en").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.select(by, "st", "en").withColumn("reach", F.max("en").over(earlier))
    islands = islands.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("st") > F.col("reach")), 1).otherwise(0)).over(upto))
    each = islands.groupBy(by, "island").agg((F.max("en") - F.min("st")).alias("length"))
    return each.groupBy(by).agg(F.sum("length").alias("union_length"), F.count("*").alias("islands"))


def peak_concurrency(spans: DataFrame, by: str = "g") -> DataFrame:
    """The most intervals at once; at equal times ends come before starts."""
    steps = spans.select(by, F.explode(F.array(F.struct(F.col("st").alias("t"), F.lit(1).alias("d")), F.struct(F.col("en").alias("t"), F.lit(-1).alias("d")))).alias("s")).select(by, "s.t", "s.d")
    net = steps.groupBy(by, "t", "d").agg(F.sum("d").alias("d_sum"))
    running = F.sum("d_sum").over(Window.partitionBy(by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return net.withColumn("open", running).groupBy(by).agg(F.greatest(F.max("open"), F.lit(0)).alias("peak"))


class _Last:
    """An id that comes first in a heap if it is the greatest; null is the least."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: "_Last") -> bool:
        return self.id is not None and (other.id is None or self.id > other.id)


def swept(rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: group, bucket, lo, hi, depth, length, span_id, label, sorted by the first three. (group, label, exclusive) of each group and bucket.

    Open spans wait in a heap, the best on top; ended ones are dropped when they get there, and all at once before the
    heap grows to twice what was open then, so it holds at most about twice the spans open at a time.
    """
    for (group, _), own in groupby(rows, lambda row: row[:2]):
        sums: dict = {}
        waiting: list[tuple] = []
        now, most = None, 1024

        def advance(now, to):
            while waiting and (to is None or now < to):
                *_, hi, label = waiting[0]
                if hi <= now:
                    heapq.heappop(waiting)
                    continue
                until = hi if to is None else min(hi, to)
                sums[label] = sums.get(label, 0) + until - now
                now = until

        for i, (_, _, lo, hi, depth, length, span_id, label) in enumerate(own):
            advance(now, lo)
            now = lo
            if len(waiting) >= most:
                waiting[:] = [x for x in waiting if x[-2] > now]
                heapq.heapify(waiting)
                most = max(1024, 2 * len(waiting))
            heapq.heappush(waiting, (float("inf") if depth is None else -depth, length, _Last(span_id), i, hi, label))
        advance(now, None)
        yield from ((group, label, length) for label, length in sums.items())


def exclusive(spans: DataFrame, by: str = "g", label: str = "category", bucket: int = 3_600_000_000) -> DataFrame:
    """Each elementary segment belongs to the deepest, then shortest, then greatest span over it; lengths by label.

    Spans are cut at the multiples of the bucket, so that a few large groups are spread over tasks, and each (group,
    bucket) is swept once in the order of starts. Bucket edges cut segments, which leaves their sums as they are.
    """
    cut = F.sequence(F.floor(F.col("st") / bucket), F.floor(F.greatest(F.col("en") - 1, F.col("st")) / bucket))
    spread = spans.filter(F.col(by).isNotNull() & (F.col("en") > F.col("st"))).select(F.col(by).alias("__by"), F.col(label).alias("__label"), "span_id", "depth", "st", "en", F.explode(cut).alias("bucket"))
    lo, hi = F.greatest("st", F.col("bucket") * bucket), F.least("en", (F.col("bucket") + 1) * bucket)
    rows = spread.select("__by", "bucket", lo.alias("lo"), hi.alias("hi"), "depth", (F.col("en") - F.col("st")).alias("length"), "span_id", "__label")

    schema = T.StructType([T.StructField(by, rows.schema["__by"].dataType), T.StructField(label, rows.schema["__label"].dataType), T.StructField("exclusive", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batched(swept(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), arrow.types, strict=True)], schema=arrow)

    sums = rows.repartition("__by", "bucket").sortWithinPartitions("__by", "bucket", "lo").mapInArrow(run, schema)
    return sums.groupBy(by, label).agg(F.sum("exclusive").alias("exclusive"))


def group_metrics(spans: DataFrame, by: str = "g") -> DataFrame:
    """Members, summed length, window, union, overlap, peak and the sum's ratio to the union (0.0 if empty)."""
    sums = spans.groupBy(by).agg(F.count("*").alias("members"), F.sum(F.col("en") - F.col("st")).alias("summed"), (F.max("en") - F.min("st")).alias("window"))
    joined = sums.join(union_length(spans, by).drop("islands"), by).join(peak_concurrency(spans, by), by)
    ratio = F.when(F.col("union_length") > 0, F.round(F.col("summed") / F.col("union_length"), 6)).otherwise(F.lit(0.0))
    return joined.select("*", (F.col("summed") - F.col("union_length")).alias("overlap"), ratio.alias("ratio"))


def coverage(spans: DataFrame, by: str = "g") -> DataFrame:
    """Covered and unattributed time of the group's makespan, and what failed and repeated attempts cover."""
    whole = spans.groupBy(by).agg((F.max("en") - F.min("st")).alias("makespan"))
    parts = {"covered": spans, "failed": spans.filter("outcome = 'failed'"), "retried": spans.filter("attempt > 1")}
    for name, rows in parts.items():
        whole = whole.join(union_length(rows, by).select(by, F.col("union_length").alias(name)), by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(by, "makespan", *(zero(c).alias(c) for c in parts), F.greatest(F.col("makespan") - zero("covered"), F.lit(0)).alias("unattributed"))


def slowest(spans: DataFrame, n: int = 10) -> DataFrame:
    return spans.select("span_id", "category", (F.col("en") - F.col("st")).alias("duration")).orderBy(F.col("duration").desc(), "span_id").limit(n)


def attempts(spans: DataFrame, by: str = "g") -> DataFrame:
    """(group, category) with more than one span or an attempt past the first."""
    rows = spans.groupBy(by, "category").agg(F.count("*").alias("n"), F.max("attempt").cast("bigint").alias("most"), F.count_if(F.col("outcome") == "failed").alias("failures"))
    return rows.filter("n > 1 OR most > 1")


def role_breakdown(spans: DataFrame, role: str = "category") -> DataFrame:
    sums = spans.groupBy(role).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.sum(F.col("en") - F.col("st")).alias("summed"), F.count_distinct("attempt").alias("attempts"))
    return sums.join(union_length(spans, role, bucket=3_600_000_000), role)  # few roles: their unions are spread over hours


def pass_numbers(spans: DataFrame, by: str = "g", role: str = "category") -> DataFrame:
    w = Window.partitionBy(by, role).orderBy("st", "span_id")
    return spans.select(by, role, "span_id", F.row_number().over(w).cast("bigint").alias("pass"))


def neighbours(spans: DataFrame, by: str = "g") -> DataFrame:
    w = Window.partitionBy(by).orderBy("st", "span_id")
    return spans.select(by, "span_id", F.lag("span_id").over(w).alias("previous"), F.lead("span_id").over(w).alias("next"))


def gate_breakdown(spans: DataFrame, gates: list[str], by: str = "g") -> DataFrame:
    """Exclusive time by gate, the longest first."""
    return exclusive(spans, by).filter(F.col("category").isin(gates)).groupBy("category").agg(F.sum("exclusive").alias("exclusive")).orderBy(F.col("exclusive").desc(), "category")


def park_intervals(parks: DataFrame) -> DataFrame:
    """Opens and closes of a park paired; exact if both lie in one boot; an open park has no end."""
    opened, closed = F.col("event") == "open", F.col("event") == "close"
    own = parks.groupBy("phase_id", "park_id").agg(F.min(F.when(opened, F.col("at"))).alias("st"), F.max(F.when(closed, F.col("at"))).alias("en"), F.min(F.when(opened, F.col("boot"))).alias("boot"), F.max(F.when(closed, F.col("boot"))).alias("__b"))
    return own.select("phase_id", "park_id", "st", "en", "boot", F.coalesce(F.col("boot") == F.col("__b"), F.lit(False)).alias("exact"))


def park_errors(parks: DataFrame) -> DataFrame:
    """Rows out of turn: a second open, or a close without an open."""
    before = F.lag("event").over(Window.partitionBy("park_id").orderBy("at", "ord"))
    fault = F.when((F.col("event") == "open") & (F.col("before") == "open"), "duplicate open").when((F.col("event") == "close") & ~F.col("before").eqNullSafe(F.lit("open")), "close without open")
    return parks.withColumn("before", before).withColumn("fault", fault).filter("fault IS NOT NULL").select("park_id", "ord", "fault")


def park_summary(parks: DataFrame) -> DataFrame:
    """Per phase: NULL while a park is open; the union by boot if all are exact, else the union by calendar."""
    pairs = park_intervals(parks)
    facts = pairs.groupBy("phase_id").agg(F.count("*").alias("parks"), F.max(F.col("en").isNull()).alias("open"), F.min(F.col("exact")).alias("all_exact"))
    closed = pairs.filter("en IS NOT NULL")
    by_boot = union_length(closed.withColumn("key", F.struct("phase_id", "boot")), "key").select(F.col("key.phase_id").alias("phase_id"), "union_length").groupBy("phase_id").agg(F.sum("union_length").alias("by_boot"))
    calendar = union_length(closed, "phase_id").select("phase_id", F.col("union_length").alias("calendar"))
    both = facts.join(by_boot, "phase_id", "left").join(calendar, "phase_id", "left")
    method: Column = F.when(F.col("open"), "incomplete").when(F.col("all_exact"), "exact-union").otherwise("calendar-union-cross-boot")
    length = F.when(F.col("open"), F.lit(None)).when(F.col("all_exact"), F.col("by_boot")).otherwise(F.col("calendar"))
    return both.select("phase_id", "parks", length.alias("total"), method.alias("method"))
