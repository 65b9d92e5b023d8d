"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Fitting (on the driver, on a bounded sample): at most `sample_rows` labelled rows of each label, the first in the order
of a hash of their ids; whole texts, at most `sample_bytes` in all per label. A text above that is passed over for the
next; where those chosen do not fit together, the longest are left out. A label none of whose texts fits is an error.
 1. Near copies are told by a minimum hash and count once. Segments are words that toxic texts hold significantly more
    often than ordinary ones (two-proportion z of `z_least` or more); the strongest `most_segments`, of at most
    `segment_bytes` each, are used.
 2. Dictionaries: a base is trained by zstandard on ordinary texts; the toxic dictionary ends in the toxic segments, the
    ordinary one in as many bytes of the most frequent ordinary words. So a window is shorter under the toxic one by
    what it shares with toxic text, and other chance matches cancel. This departs from dictionaries that are both trained:
    the trainer cuts segments of a fixed length by frequency and loses the marks of toxic text (README has the figures).
 3. Windows of 4 words, every 2 words, are compressed with both; a text is described by its largest gains and by the
    numbers and shares of windows that gain at least 5, 7 and 9 bytes. A logistic regression over the sample calibrates
    these thresholds into a probability.
Scoring reads every window of every text. Labels, ids, lang and source are never inputs of a score.

Defined results: a null text is empty; an empty text has one empty window and the score of no evidence; without labels
of both kinds the score is the share of toxic labels seen (0 if none). Repeated rows get equal scores. An empty table
gives no row.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, utf8

WINDOW, STEP, LEVEL, BASE = 4, 2, 3, 16384
GAINS = (5, 7, 9)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(words: list[bytes]) -> Iterator[bytes]:
    for i in range(0, max(1, len(words) - WINDOW + STEP), STEP):
        yield b" " + b" ".join(words[i : i + WINDOW]) + b" "


@dataclass(frozen=True)
class Model:
    """What scoring needs; under 100 kB, whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        if not self.weights:
            return lambda text: self.prior
        gains = gain_meter(self.toxic, self.ordinary)
        center, scale, weights = np.array(self.center), np.array(self.scale), np.array(self.weights)

        def score(text: bytes) -> float:
            x = (described(gains(words_of(text))) - center) / scale
            return float(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))

        return score


def gain_meter(toxic: bytes, ordinary: bytes):
    def compressor(raw: bytes):
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    with_toxic, with_ordinary = compressor(toxic), compressor(ordinary)

    def gains(words: list[bytes]) -> np.ndarray:
        return np.array([len(with_ordinary(w)) - len(with_toxic(w)) for w in windows(words)], np.int64)

    return gains


def described(gains: np.ndarray) -> np.ndarray:
    top, n = np.sort(gains)[::-1][:3], len(gains)
    above = np.array([(gains >= k).sum() for k in GAINS], float)
    return np.concatenate(([top[0], top.mean()], np.log1p(above), np.sqrt(above / n), [np.log(n), gains.mean()]))


def without_copies(texts: list[bytes]) -> list[bytes]:
    found: dict[int, bytes] = {}
    for text in texts:
        words = words_of(text)
        found.setdefault(min(zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), text)
    return list(found.values())


def fitted(toxic: list[bytes], ordinary: list[bytes], z_least: float = 5.0, most_segments: int = 400, segment_bytes: int = 4096) -> Model:
    prior = len(toxic) / max(1, len(toxic) + len(ordinary))
    if not toxic or not ordinary:
        return Model(b"", b"", (), (), (), prior)
    one, zero = without_copies(toxic), without_copies(ordinary)
    df1 = Counter(w for text in one for w in set(words_of(text)) if len(w) <= segment_bytes)
    df0 = Counter(w for text in zero for w in set(words_of(text)) if len(w) <= segment_bytes)
    n1, n0 = len(one), len(zero)

    def z(word: bytes) -> float:
        a, b = df1[word], df0[word]
        p = (a + b) / (n1 + n0)
        spread = p * (1 - p) * (1 / n1 + 1 / n0)
        return (a / n1 - b / n0) / spread**0.5 if spread > 0 else 0.0

    strength = {w: s for w in df1 if df1[w] >= 3 and (s := z(w)) >= z_least}
    segments = sorted(strength, key=lambda w: (-strength[w], w))[:most_segments]
    tail = b" " + b"".join(w + b" " for w in reversed(segments))  # the strongest stand last, nearest to the window
    other = b" "
    for word in sorted(df0, key=lambda w: (-df0[w], w)):
        if len(other) >= len(tail):
            break
        other = b" " + word + other
    samples = [b" " + b" ".join(words_of(text)) + b" " for text in zero]
    try:
        base = zstandard.train_dictionary(BASE + 512, samples).as_bytes()[-BASE:]
    except zstandard.ZstdError:  # too few or too short texts to train on: their own bytes serve
        base = b"".join(samples)[-BASE:]
    gains = gain_meter(base + tail, base + other)
    x = np.array([described(gains(words_of(t))) for t in [*toxic, *ordinary]])
    y = np.concatenate((np.ones(len(toxic)), np.zeros(len(ordinary))))
    center, scale = x.mean(0), x.std(0) + 1e-9
    rows, weights = np.c_[np.ones(len(x)), (x - center) / scale], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = (rows * (p * (1 - p))[:, None]).T @ rows + np.eye(len(weights))
        step = np.linalg.solve(slope, rows.T @ (p - y) + np.r_[0, weights[1:]])
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(base + tail, base + other, tuple(center), tuple(scale), tuple(weights), prior)


def sample(labelled: DataFrame, label: int, rows: int) -> list[bytes]:
    chosen = labelled.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    return [bytes(text) for (text,) in chosen.select("text").collect()]


def shortest(lengths: list[tuple[int, int]], most_bytes: int) -> list[int]:
    """The ids whose texts fit together, shortest first. lengths: id and length."""
    total, ids = 0, []
    for doc_id, length in sorted(lengths, key=lambda x: (x[1], x[0])):
        total += length
        if total > most_bytes:
            break
        ids.append(doc_id)
    return ids


def fit(documents: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 4000, sample_bytes: int = 24 << 20) -> Model:
    """documents: doc_id, text. labels: doc_id, toxic. train: which ids may be learned from."""
    marked = labels.filter(F.col("toxic").isin(0, 1)).filter(train).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    lengths = documents.groupBy("doc_id").agg(F.sum(F.octet_length(utf8()).cast("bigint")).alias("length"))
    sizes = persisted(marked.join(lengths, F.col("doc_id") == F.col("__id")).select("__id", "toxic", "length"), "lengths")
    few = []
    for label in (1, 0):
        own = sizes.filter(F.col("toxic") == label)
        picked = own.filter(F.col("length") <= sample_bytes).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).select("__id", "length").collect()
        if not picked and not own.isEmpty():
            raise ValueError(f"none of the texts labelled {label} fits into {sample_bytes} bytes")
        few += [(i, label) for i in shortest([tuple(p) for p in picked], sample_bytes)]
    chosen = documents.sparkSession.createDataFrame(few, "__id bigint, toxic int")  # at most 2 * sample_rows ids, so this side may be broadcast
    labelled = documents.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id")
    return fitted(sample(labelled, 1, sample_rows), sample(labelled, 0, sample_rows))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents: doc_id, text. Adds score to each row's doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", utf8().alias("text")).mapInArrow(run, "doc_id bigint, score double")


def with_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of documents, and the score of `text`."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.scorer()
        for texts in batches:
            yield pa.array([own(text.as_py()) for text in texts], pa.float64())

    return documents.withColumn(name, score(utf8()))
