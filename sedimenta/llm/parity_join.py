"""N-gram Jaccard join by parity sketches: all links of 100 |A and B| >= 75 |A or B| between sets of 5-word shingles.

Bounds. Linked sets differ in at most (a + b) / 7 shingles, and their sizes by 4 / 3 at most.

Sketches. Sets are banded by size, a band holding sizes from 4^j up to 4^(j+1); a set under 4/3 of its band's lower end
joins the band below as well, so that each linked pair meets in the band of the smaller. In band j shingles are dealt to
m = 2 * 4^j parts by hash, and each part's shingles are XORed into one parity word (in the lowest bands each shingle is
its own part). A shingle in one set only changes one part at most, so the number of differing parts, the Hamming
distance of the sketches, is a lower bound of the symmetric difference: of its N parts that are not empty, a set shares
at least t = N - d with any partner, d being the most they can differ.

Pigeonhole. In one global (hashed) order of parts' keys, both sets of a linked pair have their first p common keys among
their first d + p. So only these are emitted; a set with fewer than p keys that anyone else has is in no link. p is m / 16,
or the least t of the band if that is less; if a band has t < 1 (which takes an odd set), its parts are single shingles.

Verification. Sets that are equal form a class first, and a class has one row per task at most. Within each key the
classes are compared with the one that shares the most keys (a star), which joins a group of copies without its pairs;
then, for the keys that still hold several components, all pairs across components. Every comparison first asks the sizes and a second
parity sketch of one bit per shingle, then the sets themselves, read again from the texts of those documents alone.

Links, keys, components stay distributed. Shingles are 64-bit hashes of their words, sets 128-bit sums over them.

Defined results: null and empty texts have no shingle, link with nothing and are their own component; fewer than five
words are one shingle; repeated rows and equal texts are one class; component_id is the smallest doc_id that is not null
(null only where all are). An empty table gives no row. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, sliced, text_or_empty, utf8

WORDS, NUM, DEN = 5, 3, 4
RAW_BELOW = 3  # bands under this have a part for each shingle
BROADCAST_ROWS = 500_000
PREVIOUS = 4
MEMORY_WORDS = 500_000
_HASHES: dict[bytes, int] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > MEMORY_WORDS:
        _HASHES.clear()
    for word in set(words).difference(_HASHES):
        _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    grams = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        grams = mixed(grams * _ODD + h[i : len(words) - k + 1 + i])
    return np.unique(grams)


def signature(s: np.ndarray) -> tuple[int, int]:
    return int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(s + _ODD), initial=np.uint64(0)).view(np.int64))


def bit_sketch(s: np.ndarray) -> list[int]:
    """Parities of shingles by bit, a power of two of at least 64 bits and at least as many as there are shingles."""
    bits = max(64, 1 << max(0, int(len(s) - 1)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, the most a partner in that band differs) of a set of n shingles."""
    j = (n.bit_length() - 1) // 2
    own = [(j, n // 3)]
    if j and 3 * n < 4 * 4**j:
        own.append((j - 1, (n + 4**j - 1) // 7))
    return own


def parts_of(j: int) -> int:
    return 2 * 4**j


def common_of(j: int, raw: bool) -> int:
    return 1 if raw else max(1, parts_of(j) // 16)


def keys_of(s: np.ndarray, j: int, differ: int, raw: bool) -> tuple[np.ndarray, int]:
    """The keys that a set emits in band j, and its t."""
    if raw:
        words = s
    else:
        part = (mixed(s ^ np.uint64(j + 1)) & np.uint64(parts_of(j) - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        words = np.bitwise_xor.reduceat(s[order], starts) + part[starts].astype(np.uint64) * _ODD
    keys = np.sort(mixed(words ^ np.uint64(0x5851F42D4C957F2D * (j + 1) & 0xFFFFFFFFFFFFFFFF)))
    return keys[: differ + common_of(j, raw)], len(keys) - differ


PROFILE = "uid bigint, doc_id bigint, text_hash bigint, n bigint, sig_a bigint, sig_b bigint, sketch array<bigint>, bands array<struct<band:int,t:int,keys:array<bigint>>>"
_BANDS = pa.list_(pa.struct([("band", pa.int32()), ("t", pa.int32()), ("keys", pa.list_(pa.int64()))]))


def text_hash() -> Column:
    """With doc_id, names a row's document, as ids may repeat with other texts."""
    return F.xxhash64(text_or_empty())


def profiles(documents: DataFrame, raw_bands: frozenset[int]) -> DataFrame:
    """A row per document; only the first of equal sets in a task has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            rows = []
            for text in batch.column(3):
                s = shingles(text.as_py())
                sig = signature(s)
                own = None
                if len(s) and sig not in seen:
                    seen.add(sig)
                    own = []
                    for j, differ in bands_of(len(s)):
                        keys, t = keys_of(s, j, differ, j < RAW_BELOW or j in raw_bands)
                        own.append({"band": j, "t": t, "keys": keys.view(np.int64)})
                rows.append((len(s), *sig, bit_sketch(s), own))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), _BANDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["uid", "doc_id", "text_hash", "n", "sig_a", "sig_b", "sketch", "bands"])

    return documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_hash().alias("text_hash"), utf8().alias("text")).mapInArrow(run, PROFILE)


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles of the wanted classes (rep, id, sig_a, sig_b), from one document of each."""
    texts = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), utf8().alias("text"))
    ids = wanted.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t.as_py()) for t in batch.column(1)]
            sigs = [signature(s) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in sigs], pa.int64()), pa.array([b for _, b in sigs], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "sig_a", "sig_b", "shingles"])

    found = texts.join(ids, "id", "left_semi").mapInArrow(run, "id bigint, sig_a bigint, sig_b bigint, shingles array<bigint>")
    return found.join(wanted, ["id", "sig_a", "sig_b"]).dropDuplicates(["rep"]).select("rep", "shingles")


def may_link(a: str, b: str) -> Column:
    """Sizes and bit sketches of two aliased classes allow a link."""
    na, nb, x, y = (F.col(f"{t}.{c}") for c in ("n", "sketch") for t in (a, b))
    size = F.least(F.size(x), F.size(y))
    # allowed sizes differ by 4/3 at most, so one sketch has at most twice the other's bits and is folded once
    fold = lambda s: F.when(F.size(s) == size, s).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(s, i).bitwiseXOR(F.get(s, i + size))))
    distance = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & (distance * 7 <= na + nb)


def verified(documents: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    pairs = persisted(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = persisted(classes.join(ends, "rep", "left_semi").select("rep", "id", "sig_a", "sig_b"), "wanted")
    sets = persisted(sets_of(documents, wanted), "sets")
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return persisted(both.filter(common * DEN >= (F.size("sa") + F.size("sb") - common) * NUM).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """rep, component (the least rep it is joined with) of every end of a link: least labels, then shortcuts, until none changes."""
    edges = persisted(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = persisted(edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("rep").alias("b"), "component"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("near"))
        lower = persisted(labels.join(near, "rep").select("rep", F.least("component", "near").alias("component"), "component").toDF("rep", "component", "before"), "labels")
        jump = lower.select(F.col("rep").alias("__r"), F.col("component").alias("further"))
        short = lower.join(jump, F.col("component") == F.col("__r"), "left").select("rep", F.least("component", F.coalesce("further", "component")).alias("component"), "before")
        labels = persisted(short, "labels")
        if labels.filter("component <> before").isEmpty():
            return labels.drop("before")
        labels = labels.drop("before")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text. One row per document: doc_id, text_hash, n_shingles, class_id, component_id, stays (true for one class of each component)."""
    raw: frozenset[int] = frozenset()
    while True:
        own = persisted(profiles(documents, raw), "profiles")
        stats = own.select(F.explode("bands").alias("b")).groupBy("b.band").agg(F.min("b.t").alias("t")).collect()  # a row per band
        odd = {r["band"] for r in stats if r["t"] < 1}
        if odd <= raw:
            break
        raw |= odd
    least = F.lit(1)
    for r in stats:
        j = r["band"]
        least = F.when(F.col("band") == j, F.lit(max(1, min(r["t"], common_of(j, j < RAW_BELOW or j in raw))))).otherwise(least)

    classes = persisted(
        own.filter("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("min_doc"), F.first("sketch").alias("sketch")).withColumn("id", F.coalesce("min_doc", F.lit(-(2**63)))), "classes"
    )
    emitting = own.filter("bands IS NOT NULL").select("uid", "sig_a", "sig_b", "n").join(classes.select("sig_a", "sig_b", "n", "rep"), ["sig_a", "sig_b", "n"]).select("uid", "rep")
    emitting = persisted(emitting, "emitting")

    by_key = Window.partitionBy("key").orderBy("uid")
    keyed = own.select("uid", F.explode("bands").alias("b")).select("uid", F.col("b.band").alias("band"), F.explode("b.keys").alias("key"))
    shared = persisted(keyed.withColumn("before", F.lag("uid").over(by_key)).withColumn("after", F.lead("uid").over(by_key)).filter("before IS NOT NULL OR after IS NOT NULL").select("key", "uid", "band"), "shared")
    enough = shared.groupBy("uid", "band").agg(F.count("*").alias("keys")).filter(F.col("keys") >= least)
    near = shared.join(enough, ["uid", "band"]).join(emitting, "uid").groupBy("key", "rep").agg(F.max("keys").alias("keys"))
    facts = classes.select("rep", "n", "sketch")
    near = persisted(near, "near")
    label = F.coalesce("component", "rep")

    def ordered(pairs: DataFrame, tested: DataFrame | None = None) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return persisted(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "asked")

    def allowed(pairs: DataFrame) -> DataFrame:
        x, y = facts.withColumnRenamed("rep", "a").alias("x"), facts.withColumnRenamed("rep", "b").alias("y")
        return pairs.alias("p").join(x, "a").join(y, "b").filter(may_link("x", "y")).select("a", "b")

    def still_open(found: DataFrame) -> DataFrame:
        """The rows of keys that hold more than one component."""
        labelled = near.join(found, "rep", "left").withColumn("component", label)
        split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        return labelled.join(split, "key", "left_semi")

    # a star in each key around the class with the most shared keys, which is likely the text that others were copied from
    first = Window.partitionBy("key").orderBy(F.col("keys").desc(), "rep")
    tested = ordered(near.withColumn("hub", F.first("rep").over(first)).filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    links = verified(documents, allowed(tested), classes)
    found = components(links)

    # then every pair that is left
    # (a pair that also meets in one of the keys just before this one, in both classes' order, was asked there)
    previous = Window.partitionBy("rep").orderBy("key").rowsBetween(-PREVIOUS, -1)
    left = still_open(found).select("key", "rep", "component").withColumn("previous", F.collect_list("key").over(previous))
    open_keys = persisted(left.join(facts, "rep"), "open")
    x, y = open_keys.alias("x"), open_keys.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & ~F.arrays_overlap("x.previous", "y.previous") & may_link("x", "y"))
    more = verified(documents, ordered(across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), tested), classes)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    named = classes.join(found, "rep", "left").withColumn("component", label)
    # of a component, the class with the least id stays; of classes that share that id, the first
    least_doc = named.groupBy("component").agg(F.min("min_doc").alias("component_id"), F.min_by("rep", F.struct(F.coalesce("min_doc", F.lit(2**63 - 1)), "rep")).alias("staying"))
    named = persisted(named.join(least_doc, "component").select("sig_a", "sig_b", "n", F.col("min_doc").alias("class_id"), "component_id", (F.col("rep") == F.col("staying")).alias("class_stays")), "named")
    rows = own.select("uid", "doc_id", "text_hash", "n", "sig_a", "sig_b").withColumn("salt", F.pmod("uid", F.lit(16)).cast("int"))
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = rows.join(salted, ["sig_a", "sig_b", "n", "salt"], "left")
    alone = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    stays = F.when(F.col("n") == 0, F.lit(True)).otherwise(F.col("class_stays") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), alone("class_id"), alone("component_id"), stays.alias("stays"))
