"""Context-tree weighting: a language model over binary-decomposed bytes.

A text is read as all its bytes, lower-cased in A-Z, and an end (byte 255, which no text holds). Each byte is eight
binary decisions; each decision is made in a node, which is a context of the d bytes before (d = 0 to DEPTH) and the bits
of this byte so far. A node holds a Krichevsky-Trofimov estimate over the training counts a, b of its bit, P_e(a, b), and
its weighted probability

    P_w = 1/2 P_e + 1/2 product of P_w over the contexts one byte longer           (P_w = P_e at the greatest depth)

So P_e / 2 P_w is the posterior weight of stopping at a node, and the predictive probability of a bit mixes the KT
estimates of all depths by it; a context that training has not seen is a node without counts, whose estimate is 1/2.
Code lengths follow per byte.

Distribution. All that training needs are counts of (context, byte), which are summed by a grouped aggregation after
each task has combined its own; they grow with the corpus. The tree is cut below contexts of two bytes, and below three
where a context of two holds more than `hot_context` counts (or 1/4096 of all): a partition holds whole subtrees in
order and works through them one run of about RUN counts after another. The nodes above the cuts meet on the driver: at
most 256 * 255 + 255, and 255 for each of at most 4096 split contexts.

Scoring is one pass. Every (context, byte) that occurs anywhere has its log probability; those that occur most, at most
`top_grams` of 12 bytes, are broadcast and looked up where texts are read; the others go to the table by a shuffle join,
a row per text and (context, byte), and their sums back. As the most frequent are not among them, no key of that join is
hot. The base (unigram words, add-one) works alike: at most `top_words` of at most 64 bytes are looked up, others joined.

Held out at sf0.1 this takes 2.11 bits a byte, the base 2.19.

Defined results: a null text is empty; an empty text is its end alone, as one token and one byte; white space alone is one
token, and its bytes; repeated rows are scored alike, and counted each
time when trained on; without training texts every bit has probability 1/2. An empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, utf8

DEPTH = 5
CHUNK = 1 << 19  # bytes that are sorted at once
RUN = 1 << 19  # counts that are worked on at once, or a whole subtree if it has more
MOST_SPLIT = 4096
END = b"\xff"
HELD_WORDS, HELD_GRAMS, ROWS = 300_000, 3 << 19, 50_000
U = np.uint64
LOG2 = float(np.log(2.0))


def canonical(text: bytes) -> tuple[list[bytes], bytes]:
    """(the words, the bytes that are modelled)."""
    low = text.lower()
    return low.split(), low + END


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every place, the text it is in); the byte before is the highest, the byte itself the lowest."""
    pad = END * DEPTH
    x = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    n = len(x) - DEPTH
    grams = x[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        grams |= x[DEPTH - k : DEPTH - k + n] << U(8 * (DEPTH + 1 - k))
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + DEPTH)[DEPTH:]
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH  # of each text's own bytes, in grams
    real = np.ones(n, bool)
    for k in range(DEPTH):
        at = starts[1:] - DEPTH + k
        real[at] = False
    return grams[real], owner[real]


def chunks(texts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Texts in lists of about CHUNK bytes and of 60,000 at most; a longer text stands alone."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[1]) + DEPTH
        if size >= CHUNK or len(held) >= 60_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


COUNTS = "word binary, gram bigint, n bigint, m bigint"


def counted(documents: DataFrame) -> DataFrame:
    """documents: train, text. Words (b"" is the end) and grams with n, their count in training texts, and m, in all."""

    def rows(column: str, keys: pa.Array, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        own = {"word": pa.nulls(len(n), pa.binary()), "gram": pa.nulls(len(n), pa.int64()), "n": pa.array(n), "m": pa.array(m)} | {column: keys}
        return pa.RecordBatch.from_arrays([*own.values()], names=[*own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())  # of other texts, of training texts
        held: tuple[list, list] = ([], [])

        def texts() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for train, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own, t = canonical(text.as_py())
                    words[train].update(own)
                    words[train][b""] += 1
                    yield int(train), t

        def word_rows() -> Iterator[pa.RecordBatch]:
            for train in (0, 1):
                own = iter(words[train].items())
                while part := list(islice(own, ROWS)):
                    m = np.array([n for _, n in part], np.int64)
                    yield rows("word", pa.array([w for w, _ in part], pa.binary()), m * train, m)
                words[train].clear()

        def gram_rows(train: int) -> Iterator[pa.RecordBatch]:
            k, c = summed([k for k, _ in held[train]], [c for _, c in held[train]])
            for at in range(0, len(k), ROWS):
                yield rows("gram", pa.array(k[at : at + ROWS].view(np.int64)), c[at : at + ROWS] * train, c[at : at + ROWS])
            held[train].clear()

        for group in chunks(texts()):
            for train in (0, 1):
                if own := [t for k, t in group if k == train]:
                    held[train].append(np.unique(grams_of(own)[0], return_counts=True))
                if sum(len(k) for k, _ in held[train]) > HELD_GRAMS:
                    both = summed([k for k, _ in held[train]], [c for _, c in held[train]])
                    held[train][:] = [both]
                    if len(both[0]) > HELD_GRAMS * 2 // 3:
                        yield from gram_rows(train)
            if len(words[0]) + len(words[1]) > HELD_WORDS:
                yield from word_rows()
        yield from word_rows()
        for train in (0, 1):
            if held[train]:
                yield from gram_rows(train)

    return documents.select("train", "text").mapInArrow(run, COUNTS).groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series after seven steps of recurrence."""
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def weighted(estimate: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log P_w, posterior weight of stopping) of nodes with log P_e and the sum of log P_w one byte longer."""
    both = np.logaddexp(estimate, longer) - LOG2
    return both, np.exp(estimate - LOG2 - both)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


class Subtrees:
    """The nodes of contexts of `least` to DEPTH bytes for sorted grams, a bit level at a time."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, least: int):
        self.grams, self.n, self.least = grams, n.astype(float), least

    def level(self, bit: int):
        """For each depth from DEPTH to least: (node of each gram, counts a and b of nodes, log P_w, weight of stopping, names)."""
        byte = self.grams & U(255)
        prefix = byte >> U(8 - bit)
        one = ((byte >> U(7 - bit)) & U(1)).astype(bool)
        out, previous = [], None
        for depth in range(DEPTH, self.least - 1, -1):
            keys = ((self.grams >> U(8 * (DEPTH + 1 - depth))) << U(8)) | prefix
            names, node = np.unique(keys, return_inverse=True)
            a = np.bincount(node, self.n * ~one, len(names))
            b = np.bincount(node, self.n * one, len(names))
            estimate = log_kt(a, b)
            if previous is None:
                log_w, stop = estimate, np.ones(len(names))
            else:
                lower_node, lower_w = previous
                parent = np.zeros(len(lower_w), np.int64)
                parent[lower_node] = node
                log_w, stop = weighted(estimate, np.bincount(parent, lower_w, len(names)))
            out.append((node, a, b, log_w, stop, names))
            previous = (node, log_w)
        return one, prefix, out

    def roots(self) -> tuple[np.ndarray, ...]:
        """(depth least - 1, context and node 1 to 255, a, b, sum of log P_w) summed over the last byte of the context."""
        rows = []
        for bit in range(8):
            _, _, levels = self.level(bit)
            _, a, b, log_w, _, names = levels[-1]
            key = ((names >> U(16)) << U(8)) | (names & U(255)) | U(1 << bit)
            rows.append((key, a, b, log_w))
        key = np.concatenate([r[0] for r in rows])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = starts_of(key)
        return (np.full(len(first), self.least - 1), key[first].astype(np.int64), *(np.add.reduceat(np.concatenate([r[i] for r in rows])[order], first) for i in (1, 2, 3)))

    def log10_probability(self, top: "Top") -> np.ndarray:
        total = np.zeros(len(self.grams))
        for bit in range(8):
            one, prefix, levels = self.level(bit)
            place = (1 << bit) | prefix.astype(np.int64)
            nodes = top.above(self.grams, place, self.least)
            nodes += [(a[node], b[node], stop[node]) for node, a, b, _, stop, _ in reversed(levels)]
            p = None
            for a, b, stop in reversed(nodes):
                own = (np.where(one, b, a) + 0.5) / (a + b + 1)
                p = own if p is None else stop * own + (1 - stop) * p
            total += np.log10(p)
        return total


class Top:
    """The nodes above the cuts: of contexts of no and of one byte in fixed tables of 256 and 256 * 256 places, and of
    split contexts of two bytes by name."""

    def __init__(self, rows: list[tuple[int, int, float, float, float]]):
        self.a1, self.b1, longer = (np.zeros((256, 256)) for _ in range(3))
        split = sorted(r[1:] for r in rows if r[0] == 2)
        self.names = np.array([r[0] for r in split], np.int64)
        self.a2, self.b2, longer2 = (np.array([r[i] for r in split], float) for i in (1, 2, 3))
        log_w2, self.stop2 = weighted(log_kt(self.a2, self.b2), longer2)
        ones = [r[1:] for r in rows if r[0] == 1] + [((int(k) >> 16) << 8 | int(k) & 255, a, b, w) for k, a, b, w in zip(self.names, self.a2, self.b2, log_w2, strict=True)]
        for key, a, b, log_w in ones:
            self.a1[key >> 8, key & 255] += a
            self.b1[key >> 8, key & 255] += b
            longer[key >> 8, key & 255] += log_w
        log_w, self.stop1 = weighted(log_kt(self.a1, self.b1), longer)
        self.a0, self.b0 = self.a1.sum(0), self.b1.sum(0)
        _, self.stop0 = weighted(log_kt(self.a0, self.b0), log_w.sum(0))

    def above(self, grams: np.ndarray, place: np.ndarray, least: int) -> list[tuple[np.ndarray, ...]]:
        """(a, b, weight of stopping) of each gram's nodes at depths under least."""
        before = (grams >> U(8 * DEPTH)).astype(np.int64)
        out = [(self.a0[place], self.b0[place], self.stop0[place]), (self.a1[before, place], self.b1[before, place], self.stop1[before, place])]
        if least == 3:
            at = np.searchsorted(self.names, ((grams >> U(8 * (DEPTH - 1))).astype(np.int64) << 8) | place)
            out.append((self.a2[at], self.b2[at], self.stop2[at]))
        return out


def runs(batches: Iterator[pa.RecordBatch], split: np.ndarray) -> Iterator[Subtrees]:
    """Whole subtrees of sorted grams, about RUN counts at a time. split: contexts of two bytes that are cut at three."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(everything: bool) -> Iterator[Subtrees]:
        grams, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        two = grams >> U(8 * (DEPTH - 1))
        is_split = np.isin(two, split)
        subtree = np.where(is_split, grams >> U(8 * (DEPTH - 2)), two << U(8))
        whole = len(grams) if everything else int(np.searchsorted(subtree, subtree[-1]))
        held[:] = [(grams[whole:], n[whole:])]
        for least, own in ((2, ~is_split[:whole]), (3, is_split[:whole])):
            if own.any():
                yield Subtrees(grams[:whole][own], n[:whole][own], least)

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(g) for g, _ in held) >= RUN:
                yield from cut(False)
    if held:
        yield from cut(True)


def probabilities(grams: DataFrame, hot_context: int = 1 << 16) -> DataFrame:
    """grams: gram, n. The log10 probability of each gram's byte in its context: gram, log10p."""
    two = F.shiftrightunsigned("gram", 8 * (DEPTH - 1))
    sizes = grams.groupBy(two.alias("two")).count().collect()  # at most 65,536 rows
    least = max(hot_context, sum(r["count"] for r in sizes) // MOST_SPLIT)
    hot = sorted(r["two"] for r in sizes if r["count"] > least)
    split = np.array(hot, np.uint64)
    third = F.when(two.isin(hot), F.shiftrightunsigned("gram", 8 * (DEPTH - 2))) if hot else F.lit(None).cast("bigint")
    by_context = grams.select("gram", "n").repartition(two, third).sortWithinPartitions("gram")

    def top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, split):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.roots()], names=["depth", "key", "a", "b", "log_w"])

    rows = by_context.mapInArrow(top_rows, "depth bigint, key bigint, a double, b double, log_w double").groupBy("depth", "key").agg(F.sum("a"), F.sum("b"), F.sum("log_w"))
    top = Top([tuple(r) for r in rows.collect()])  # at most 256 * 255 rows, and 255 for each of at most MOST_SPLIT contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, split):
            yield pa.RecordBatch.from_arrays([pa.array(found.grams.view(np.int64)), pa.array(found.log10_probability(top).astype(np.float32))], names=["gram", "log10p"])

    return by_context.mapInArrow(run, "gram bigint, log10p float")


def frequent(counts: DataFrame, most: int) -> int:
    """The least count m that at most `most` rows reach."""
    histogram = counts.groupBy(F.least("m", F.lit(65_535)).alias("m")).count().collect()  # at most 65,535 rows
    held, least = 0, 1 << 62
    for m, n in sorted(((r["m"], r["count"]) for r in histogram), reverse=True):
        if held + n > most:
            break
        held, least = held + n, m
    return least


_SCORES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("tf", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SCORES = "uid bigint, doc_id bigint, word binary, gram bigint, tf bigint, tokens bigint, bytes bigint, known bigint, base double, score double"


def score_rows(**columns: object) -> pa.RecordBatch:
    n = len(columns["uid"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCORES], schema=_SCORES)


def scored(documents: DataFrame, train: Column, top_words: int = 150_000, top_grams: int = 1 << 20) -> DataFrame:
    """documents: doc_id, text. One row per document: doc_id, n_tokens, n_bytes, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    counts = persisted(counted(documents.select(train.alias("train"), utf8().alias("text"))), "counts")
    words, grams = counts.filter("word IS NOT NULL").select("word", "n", "m"), counts.filter("gram IS NOT NULL").select("gram", "n", "m")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    floor = float(np.log10(total + 1 * (distinct + 1)))
    is_top = (F.col("m") >= frequent(words, top_words)) & (F.octet_length("word") <= 64)
    top = spark.sparkContext.broadcast({bytes(w): float(np.log10(n + 1)) - floor for w, n in words.filter(is_top).select("word", "n").collect()})
    logs = persisted(probabilities(grams), "grams")
    least = frequent(grams, top_grams)
    own = logs.join(grams.filter(F.col("m") >= least).select("gram"), "gram", "left_semi").toArrow()  # at most top_grams rows
    keys = own["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = spark.sparkContext.broadcast((keys[order], own["log10p"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, log10p = values.value
        known = top.value

        def rows() -> Iterator[tuple[tuple, bytes]]:
            for batch in batches:
                for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    tokens, t = canonical(text.as_py())
                    tokens.append(b"")
                    found = [*map(known.get, tokens)]
                    rare = Counter(w for w, v in zip(tokens, found, strict=True) if v is None)
                    looked_up = [v for v in found if v is not None]
                    yield (uid, doc_id, len(tokens), len(t), sum(v > -floor for v in looked_up), float(sum(looked_up)), rare), t

        for group in chunks(rows()):
            codes, owner = grams_of([t for _, t in group])
            pairs = np.sort((codes << U(16)) | owner.astype(np.uint64))
            codes, owner = pairs >> U(16), (pairs & U(0xFFFF)).astype(np.int64)
            first = starts_of(codes)
            times = np.diff(np.append(first, len(codes)))
            if len(table):
                at = np.minimum(np.searchsorted(table, codes[first]), len(table) - 1)
                hit = table[at] == codes[first]
                value = np.where(hit, log10p[at], 0.0).astype(float)
            else:
                hit, value = np.zeros(len(first), bool), np.zeros(len(first))
            sums = np.bincount(owner, np.repeat(value, times), len(group))
            uid, doc_id, tokens, size, n_known, base, rare = zip(*(row for row, _ in group), strict=True)
            yield score_rows(uid=uid, doc_id=doc_id, tokens=tokens, bytes=size, known=n_known, base=base, score=sums)
            flat = [(u, w, n) for u, own in zip(uid, rare, strict=True) for w, n in own.items()]
            for i in range(0, len(flat), ROWS):
                u, w, n = zip(*flat[i : i + ROWS], strict=True)
                yield score_rows(uid=u, word=w, tf=n)
            left = pairs[np.repeat(~hit, times)]
            begin = starts_of(left) if len(left) else np.zeros(0, np.int64)
            tf, left, uids = np.diff(np.append(begin, len(left))), left[begin], np.array(uid, np.int64)
            for i in range(0, len(left), ROWS):
                part = left[i : i + ROWS]
                yield score_rows(uid=uids[(part & U(0xFFFF)).astype(np.int64)], gram=(part >> U(16)).view(np.int64), tf=tf[i : i + ROWS])

    texts = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", utf8().alias("text"))
    rows = persisted(texts.mapInArrow(run, SCORES), "scores")  # one pass gives a document's rows their uid
    rare_words = rows.filter("word IS NOT NULL").select("uid", "word", "tf").join(words.filter(~is_top).select("word", "n"), "word")
    log = F.log10(F.col("n") + 1.0) - F.lit(floor)
    of_words = rare_words.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(F.lit(0))).alias("known"), F.sum(F.col("tf") * log).alias("base"))
    of_grams = rows.filter("gram IS NOT NULL").select("uid", "gram", "tf").join(logs, "gram").groupBy("uid").agg(F.sum(F.col("tf") * F.col("log10p").cast("double")).alias("score"))
    parts = rows.filter("tokens IS NOT NULL").select("uid", "doc_id", "tokens", "bytes", "known", "base", "score")
    parts = parts.unionByName(of_words, allowMissingColumns=True).unionByName(of_grams, allowMissingColumns=True)
    return parts.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("tokens").alias("n_tokens"),
        F.max("bytes").alias("n_bytes"),
        F.sum("known").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("uid")
