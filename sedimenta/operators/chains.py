"""Event chains, ordered logs, and proofs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.lineage import cut

TRANSITIONS = (("system", "user"), ("user", "assistant"), ("assistant", "user"))


def heads(events: DataFrame) -> DataFrame:
    """The events that none follows."""
    followed = events.filter("previous IS NOT NULL").select(F.col("previous").alias("id")).distinct()
    return events.join(followed, "id", "left_anti").select("chain", "id", "state")


def violations(events: DataFrame, transitions: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """Events whose predecessor is missing, or whose step from it is not allowed."""
    before = events.select(F.col("id").alias("previous"), F.col("state").alias("from_state")).distinct()
    joined = events.filter("previous IS NOT NULL").join(before, "previous", "left")
    allowed = F.lit(False)
    for a, b in transitions:
        allowed = allowed | ((F.col("from_state") == a) & (F.col("state") == b))
    fault = F.when(F.col("from_state").isNull(), "previous missing").when(~allowed, "transition")
    return joined.withColumn("fault", fault).filter("fault IS NOT NULL").select("chain", "id", "from_state", "state", "fault")


def regressions(rows: DataFrame, at: str, order: str, by: str | None = None) -> DataFrame:
    """Rows earlier than the row before them; without groups, ranges of the order are compared side by side, and each range's
    first row with the last of the range before it."""
    if by:
        return rows.withColumn("before", F.lag(at).over(Window.partitionBy(by).orderBy(order))).filter(F.col(at) < F.col("before"))
    parts = cut(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    edges = parts.groupBy("__part").agg(F.max_by(at, order).alias("__last"))
    edges = edges.withColumn("__edge", F.lag("__last").over(Window.orderBy("__part"))).drop("__last")  # a row per range
    inside = parts.withColumn("before", F.lag(at).over(Window.partitionBy("__part").orderBy(order))).join(F.broadcast(edges), "__part")
    return inside.withColumn("before", F.coalesce("before", "__edge")).filter(F.col(at) < F.col("before")).drop("__part", "__edge")


def blocks(lines: DataFrame, header: str) -> DataFrame:
    """Lines with the number of the block that their last header began; lines before any are in block 0."""
    starts = F.when(F.col("line").rlike(header), 1).otherwise(0)
    return lines.withColumn("block", F.sum(starts).over(Window.partitionBy("log").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def without_marker(lines: DataFrame, header: str, marker: str) -> DataFrame:
    """Blocks in which no line matches the marker."""
    return blocks(lines, header).filter("block > 0").groupBy("log", "block").agg(F.max(F.col("line").rlike(marker)).alias("marked")).filter("NOT marked").select("log", "block")


def glob_to_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression: *, ?, [..] and [!..]; case counts."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c)
        i += 1
    return f"(?s)^{''.join(out)}$"


def selected(items: DataFrame, selectors: dict[str, list[str]], column: str) -> DataFrame:
    """Each item with the families whose selectors match it; selectors become one array expression, not a join."""
    families = F.array_compact(F.array(*(F.when(F.greatest(*(F.col(column).rlike(glob_to_regex(g)) for g in [*globs, globs[0]])), F.lit(name)) for name, globs in sorted(selectors.items()))))
    return items.withColumn("family", F.explode(families))


def proof_counts(proofs: DataFrame) -> DataFrame:
    return proofs.groupBy("kind").agg(F.count("*").alias("proofs"), F.count_distinct("family").alias("families"))


def ready(events: DataFrame, dependencies: DataFrame, done: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Chains all of whose dependencies (chain, depends_on) have a head in a done state."""
    finished = heads(events).filter(F.col("state").isin(*done)).select(F.col("chain").alias("depends_on")).distinct()
    open_ones = dependencies.join(finished, "depends_on", "left_anti").select("chain").distinct()
    return dependencies.select("chain").distinct().join(open_ones, "chain", "left_anti")


def families_of(paths: DataFrame, selectors: dict[str, list[str]]) -> DataFrame:
    """Each changed path with the families whose selectors cover it; a path of none, or of several, widens the selection to all."""
    families = F.array_compact(F.array(*(F.when(F.greatest(*(F.col("path").rlike(glob_to_regex(g)) for g in [*globs, globs[0]])), F.lit(name)) for name, globs in sorted(selectors.items()))))
    return paths.select("path", families.alias("families")).withColumn("widens", F.size("families") != 1)


def timings(measured: DataFrame, current: DataFrame, n: int = 5) -> DataFrame:
    """Proofs without a measurement, measurements without a proof, and the n slowest of the rest: proof, kind, seconds."""
    unmeasured = current.join(measured, "proof", "left_anti").select("proof", F.lit("unmeasured").alias("kind"), F.lit(None).cast("double").alias("seconds"))
    gone = measured.join(current, "proof", "left_anti").select("proof", F.lit("gone").alias("kind"), "seconds")
    slowest = measured.join(current, "proof", "left_semi").orderBy(F.col("seconds").desc(), "proof").limit(n).select("proof", F.lit("slowest").alias("kind"), "seconds")
    return unmeasured.unionByName(gone).unionByName(slowest)


def corrected(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks: ord, hash, at, corrects (the hash of an earlier block, or NULL). (blocks whose times the corrections moved forward,
    corrections that name no earlier block or more than one)."""
    fixes = blocks.filter("corrects IS NOT NULL").select(F.col("ord").alias("fix"), F.col("at").alias("new_at"), F.col("corrects").alias("hash"))
    named = fixes.join(blocks.select("hash", "ord"), "hash").filter(F.col("ord") < F.col("fix"))
    single = named.groupBy("fix").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.min("new_at").alias("new_at")).filter("n = 1")
    bad = blocks.filter("corrects IS NOT NULL").join(single.select(F.col("fix").alias("ord")), "ord", "left_anti")
    moved = single.groupBy("ord").agg(F.max("new_at").alias("new_at"))
    return blocks.join(moved, "ord", "left").withColumn("at", F.greatest("at", F.coalesce("new_at", "at"))).drop("new_at"), bad
