"""Mixing sources to target weights by entropy balancing.

Targets: sources, ordered by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share `budget` times all words;
none may exceed `most` times its own words, and what is cut off is shared again by weight until none is above.

Rates: each document i of source s gets a rate r_i in [0, most] that is nearest in entropy to the base rate most / 2 under
the source's token constraint, sum r_i size_i = target. The convex dual has one unknown per source, and its solution is
an exponential tilt of the odds, r / (most - r) = exp(lambda_s size_i / mean size): where more is wanted than the base
gives, long documents are repeated more, where less is wanted, fewer of them are kept. Newton's iterations run as
grouped aggregations over the histogram (source, size, count), which is built once; each iteration writes its
parameters, a row per source. Moments are summed as whole multiples of 2**-20, so their sums, and with them the rates,
do not depend on the order in which rows arrive.

Rounding: copies are floor(r), and the rest of the target goes to documents in the order of a keyed hash over their
fraction, up to the last that fits. That last place is found by radix selection (grouped histograms of 4096 buckets per
source), never by sorting a source in one task. Documents that do not fit are passed over: the selection is repeated on
what is left, over the documents no larger than it, until none fits; then likewise over further copies, up to `most`.
So less than the smallest document that may still be taken is left, and that one is taken if it comes nearer. Places
are functions of ids and sizes; only rows that share both are told apart by their uid, so reruns agree.

Defined results: a null text has size 0; a null source is a source; a source without words has target 0; documents of
size 0 are taken 0 words and rounded like others; repeated rows are documents of their own; an empty table gives no
row. Other columns are ignored, or kept by `mixed`.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import WORD, persisted, text_or_empty

WEIGHTS = (5, 2, 1)
BITS, ROUNDS, TIE_ROUNDS = 12, 3, 2
BUCKETS = 1 << BITS


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table of a row per source, in few files: it is read in every round."""
    return persisted(df.coalesce(8), name)


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 in the order of source, null last: ranges of sources are numbered side by side."""
    parts = persisted(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("inside", inside).join(offsets, "part").withColumn("rank", F.col("inside") + F.col("offset")).drop("part", "n", "offset", "inside")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: source, words, docs. Adds weight, target."""
    place = (F.col("rank") % len(weights) + 1).cast("int")
    weighted = kept(ranked(sources).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place)).drop("rank"), "sources")
    total = weighted.agg(F.sum("words")).first()[0] or 0
    goal = budget * total
    level = 0.0
    while True:  # the level only rises; each pass caps one more source at least
        full = F.col("words") * most <= F.col("weight") * F.lit(level)
        capped, open_weight = weighted.agg(F.coalesce(F.sum(F.when(full, F.col("words") * most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (goal - capped) / open_weight if open_weight else level
        if new <= level * (1 + 1e-12) or not open_weight:
            break
        level = new
    return weighted.withColumn("target", F.least(F.col("words") * F.lit(float(most)), F.col("weight") * F.lit(float(level))))


def tilted(histogram: DataFrame, sources: DataFrame, most: float = 2.0, tolerance: float = 1e-7, iterations: int = 60) -> DataFrame:
    """sources with share, mean, tilt: the dual's solution. histogram: source, size, n.

    A Newton step is cut to the tilt's own length (2 at least), so that shares near the ends, whose tilts are large, are
    approached by doubling; what misses the target by less than `tolerance` of the source's words is left to the rounding.
    """
    share = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    params = kept(sources.withColumn("share", share).withColumn("mean", F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9))).withColumn("tilt", F.lit(0.0)).withColumn("open", inner(most)), "params")
    own = params.columns
    x = F.col("size") / F.col("mean")
    rate, _ = rates(most)
    whole = lambda e: F.sum(F.round(F.col("n") * e * 2**20).cast("decimal(38,0)")).cast("double") / 2**20
    for _ in range(iterations):
        moving = params.filter("open")
        moments = histogram.join(moving.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).groupBy("source")
        moments = moments.agg(whole((rate - F.col("share")) * x).alias("miss"), whole(rate * (1 - rate / most) * x * x).alias("slope"), whole(x).alias("all"))
        joined = params.join(moments.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
        far = F.col("open") & (F.abs("miss") > tolerance * F.col("all"))
        longest = F.greatest(F.abs("tilt"), F.lit(2.0))
        step = F.when(F.col("slope") > 0, F.col("miss") / F.col("slope")).otherwise(F.signum("miss") * longest)
        step = F.greatest(F.least(step, longest), -longest)
        moved = F.when(far, F.col("tilt") - step).otherwise(F.col("tilt"))
        params = kept(joined.select(*(c for c in own if c not in ("tilt", "open")), moved.alias("tilt"), F.coalesce(far, F.lit(False)).alias("open")), "params")
        if params.filter("open").isEmpty():
            break
    return params.drop("open")


def inner(most: float) -> Column:
    return (F.col("share") > 0) & (F.col("share") < most * (1 - 1e-9))


def rates(most: float) -> tuple[Column, Column]:
    """A document's rate from share, tilt, size, mean; and the same with the ends of the range taken exactly."""
    odds = F.exp(F.least(F.greatest(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(-60.0)), F.lit(60.0)))
    rate = F.lit(float(most)) * odds / (1 + odds)
    return rate, F.when(F.col("share") <= 0, F.lit(0.0)).when(~inner(most), F.lit(float(most))).otherwise(rate)


def cuts(open_: DataFrame, left: DataFrame) -> DataFrame:
    """source, cut, left: in each source the rows with place < cut fit together, and what they leave. open_: source, size, place."""
    left = left.select("source", "left", F.lit(0).cast("bigint").alias("cut"), F.lit(True).alias("deeper"))
    for k in reversed(range(ROUNDS + TIE_ROUNDS)):  # digits of the last place that fits, from the highest
        left = kept(left, "left")
        if left.filter("deeper").isEmpty():
            return left
        at = open_.join(left.withColumnRenamed("source", "__s").drop("left").filter("deeper"), F.col("source").eqNullSafe(F.col("__s")))
        digit = F.shiftright(F.col("place") - F.col("cut"), BITS * k)
        sums = at.filter((F.col("place") >= F.col("cut")) & (digit < BUCKETS)).groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        running = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("source", "__s")
        both = left.join(running, F.col("source").eqNullSafe(F.col("__s")), "left")
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("digit", "n")))
        taken = F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto")))
        left = both.groupBy("source").agg(F.first("cut").alias("cut0"), F.first("left").alias("left0"), F.first("deeper").alias("deeper0"), over.alias("over"), taken.alias("taken"))
        # where every bucket fits, the cut lies past all of them; a bucket of one row need not be searched
        cut = F.col("cut0") + F.when(F.col("deeper0"), F.coalesce("over.digit", F.lit(BUCKETS)) * F.lit(1 << BITS * k)).otherwise(F.lit(0))
        left = left.select("source", (F.col("left0") - F.coalesce("taken", F.lit(0))).alias("left"), cut.cast("bigint").alias("cut"), (F.coalesce("over.n", F.lit(0)) > 1).alias("deeper"))
    return kept(left, "left")


def with_copies(sized: DataFrame, key: str = "mix", weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized: uid (unique), doc_id, source, size. Adds source_size, target, rate, copies."""
    spread = F.pmod(F.xxhash64("uid"), F.lit(64)).cast("int")
    sources = sized.groupBy("source", spread.alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("docs")).groupBy("source").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs"))
    histogram = persisted(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    params = tilted(histogram, with_targets(sources, weights, budget, most), most)
    named = params.withColumnRenamed("source", "__s")
    _, rate = rates(most)
    unit = F.pmod(F.xxhash64(F.lit(key), F.col("doc_id"), F.col("size")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = sized.join(named, F.col("source").eqNullSafe(F.col("__s"))).withColumn("rate", rate)
    whole = F.floor(F.col("rate") + 1e-9)
    part = F.col("rate") - whole
    scale = BUCKETS**ROUNDS
    rated = rated.withColumn("copies", whole.cast("int")).withColumn("order", F.when(part > 1e-9, F.least(F.floor(unit / (unit + part) * scale), F.lit(scale - 1)).cast("bigint")))
    rated = persisted(rated.select("uid", "doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", "copies", "order"), "rated")

    chosen = rated.withColumn("topped", F.lit(False))
    left = rated.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"))
    fresh, further = F.col("order").isNotNull() & ~F.col("topped"), (F.col("copies") < int(most)) & (F.col("size") > 0)
    fits = F.col("size") <= F.col("left")
    for turn in count():
        left = kept(left, "left")
        at = chosen.join(left.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").filter(fits)
        turns = at.filter("size > 0").groupBy("source").agg(F.coalesce(F.max(fresh), F.lit(False)).alias("by_order"), F.max(fresh | further).alias("any")).filter("any")
        turns = kept(turns.select(F.col("source").alias("__s"), "by_order"), "turns")
        if turns.isEmpty():
            break
        tie = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1 << BITS * TIE_ROUNDS))
        place = F.coalesce("order", F.lit(scale - 1)) * F.lit(1 << BITS * TIE_ROUNDS) + tie
        open_ = at.join(turns, F.col("source").eqNullSafe(F.col("__s"))).filter(F.when(F.col("by_order"), fresh).otherwise(further)).select("uid", "source", "size", place.alias("place"))
        cut = cuts(open_, left)
        more = open_.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).filter("place < cut").select("uid", F.lit(1).alias("more"))
        chosen = persisted(chosen.join(more, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).withColumn("topped", F.col("topped") | F.col("more").isNotNull()).drop("more"), "chosen")
        left = cut.select("source", "left")
    gap = left.select(F.col("source").alias("__s"), F.col("left").alias("gap"))
    free = chosen.filter(further).join(gap, F.col("source").eqNullSafe(F.col("__s"))).filter(F.abs(F.col("gap") - F.col("size")) < F.abs("gap"))
    best = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), F.col("doc_id"), F.col("uid"))).alias("b")).select(F.col("b.uid").alias("uid"), F.lit(1).alias("more"))
    chosen = persisted(chosen.join(best, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more", "topped", "order"), "chosen")
    return chosen


def sized(documents: DataFrame, *columns: str) -> DataFrame:
    """uid, doc_id, source, size (words of the text) and the named columns; written once, so uid is stable."""
    return persisted(documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"), *columns), "sized")


def mixed(documents: DataFrame, **options: object) -> DataFrame:
    """documents, each as often as the mix takes it; the same columns."""
    keep = [c for c in documents.columns if c not in ("doc_id", "source")]
    rows = sized(documents, *(F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)))
    copies = with_copies(rows.select("uid", "doc_id", "source", "size"), **options).select("uid", "copies").filter("copies > 0")
    # copies grow with the corpus, so they are never broadcast, however few they are
    back = rows.join(copies.hint("merge"), "uid").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return back.select(*(F.col(c) if c in ("doc_id", "source") else F.col(f"__c{keep.index(c)}").alias(c) for c in documents.columns))
