"""Incremental index maintenance: new journal records are folded in as they come; late or repeated ones stop the stream.

The index lives in generations, a folder each of Parquet, named by batch. A batch reads the one before it, checks its
records against the tail (the greatest (instant, event_id) so far; instants are compared, not their texts), against all
event ids of earlier batches and against the sizes and media types on record, folds them, and writes its generation of
objects and names, and its ids; a repeated batch writes the same ones again. Records at or before the tail, known ids and
changes that are no refinement are not dropped: they raise, and the caller derives the batch's generation from the whole
journal by `rebuild`, which the next batch then follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimenta.functions.scalars import instant
from sedimenta.operators.index import media_conflicts
from sedimenta.schemas import JOURNAL, NAMES, REFINEMENTS


class OutOfOrder(RuntimeError):
    """A record that the index cannot take in order."""


PLACE = "struct<t:timestamp,event_id:string>"
STATE = f"cas_id string, size bigint, media_type string, first_seen_utc string, batch string, records bigint, last {PLACE}"


def place() -> Column:
    return F.struct(instant(F.col("at")).alias("t"), F.col("event_id").alias("event_id"))


def fold(records: DataFrame) -> DataFrame:
    order = place()
    return records.groupBy("cas_id").agg(F.min("size").alias("size"), F.max_by("media_type", order).alias("media_type"), F.min_by("at", order).alias("first_seen_utc"), F.min_by("batch", order).alias("batch"), F.count("*").alias("records"), F.max(order).alias("last"))


def merged(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index after new objects and records: as fold of both journals, since all new records are later."""
    both = index.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("cas_id").agg(F.min("size").alias("size"), F.max_by("media_type", "__new").alias("media_type"), F.min_by("first_seen_utc", "__new").alias("first_seen_utc"), F.min_by("batch", "__new").alias("batch"), F.sum("records").alias("records"), F.max("last").alias("last"))


def fold_names(records: DataFrame) -> DataFrame:
    return records.groupBy("cas_id", "source_root_id", "original_relpath").agg(F.min_by("at", place()).alias("recorded_utc"))


def merged_names(names: DataFrame, new: DataFrame) -> DataFrame:
    """Names that are known stay as they were first seen."""
    fresh = new.join(names, ["cas_id", "source_root_id", "original_relpath"], "left_anti")
    return names.unionByName(fresh)


def object_conflicts(index: DataFrame, records: DataFrame) -> DataFrame:
    """Objects to which the records give another size, or a media type that does not refine the one before it: cas_id."""
    known = index.select("cas_id", F.col("size").alias("__size"), F.col("media_type").alias("__media"))
    first = records.groupBy("cas_id").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min_by("media_type", place()).alias("media"))
    refines = F.col("__media") == F.col("media")
    for old, new in REFINEMENTS:
        refines = refines | ((F.col("__media") == old) & (F.col("media") == new))
    across = first.join(known, "cas_id").filter(~refines | (F.col("least") != F.col("__size"))).select("cas_id")
    sizes = first.filter("least <> most").select("cas_id")
    return across.unionByName(sizes).unionByName(media_conflicts(records.withColumn("ord", place())).select("cas_id")).distinct()


class Catchup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generation(self, n: int) -> str:
        return f"{self.path}/generation-{n:08d}"

    def index(self, n: int | None = None) -> DataFrame:
        if n is None:
            n = self.latest()
        return self.spark.read.schema(STATE).parquet(self.generation(n)) if n >= 0 else self.spark.createDataFrame([], STATE)

    def names(self, n: int | None = None) -> DataFrame:
        if n is None:
            n = self.latest()
        return self.spark.read.schema(NAMES).parquet(f"{self.path}/names-{n:08d}") if n >= 0 else self.spark.createDataFrame([], NAMES)

    def latest(self) -> int:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [int(x.rpartition("-")[2]) for x in names if x.startswith("generation-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return max(done, default=-1)

    def ids(self, before: int) -> DataFrame:
        """The event ids of all batches before this one."""
        paths = [f"{self.path}/ids-{n:08d}" for n in range(before)]
        return self.spark.read.schema("event_id string").parquet(*paths) if paths else self.spark.createDataFrame([], "event_id string")

    def _write(self, index: DataFrame, names: DataFrame, records: DataFrame, batch_id: int) -> None:
        names.write.mode("overwrite").parquet(f"{self.path}/names-{batch_id:08d}")
        records.select("event_id").write.mode("overwrite").parquet(f"{self.path}/ids-{batch_id:08d}")
        index.write.mode("overwrite").parquet(self.generation(batch_id))

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """One batch; a batch that ran before is written again from the same generation before it."""
        before = self.index(batch_id - 1)
        tail = before.agg(F.max("last").alias("last")).select("last.*").first()
        facts = records.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_if(instant(F.col("at")).isNull()).alias("odd"), F.min(place()).alias("least")).first()
        if facts["odd"]:
            raise OutOfOrder("a record has no valid time")
        if facts["n"] != facts["ids"]:
            raise OutOfOrder("an event id is repeated")
        if tail["t"] is not None and facts["n"] and tuple(facts["least"]) <= tuple(tail):
            raise OutOfOrder(f"a record at {facts['least']['t']} is not after {tail['t']}")
        if not records.select("event_id").join(self.ids(batch_id), "event_id", "left_semi").isEmpty():
            raise OutOfOrder("an event id is known from an earlier batch")
        if found := object_conflicts(before, records).limit(3).collect():
            raise OutOfOrder(f"objects change in a way that is no refinement: {[r[0] for r in found]}")
        self._write(merged(before, fold(records)), merged_names(self.names(batch_id - 1), fold_names(records)), records, batch_id)

    def rebuild(self, journal: DataFrame, batch_id: int) -> None:
        """The generation of a refused batch, derived from the whole journal up to and with it; batch_id + 1 goes on from there."""
        for n in range(batch_id):  # ids of earlier batches are in the journal too
            self.spark.createDataFrame([], "event_id string").write.mode("overwrite").parquet(f"{self.path}/ids-{n:08d}")
        self._write(fold(journal), fold_names(journal), journal, batch_id)

    def start(self, source: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
        stream = self.spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).json(source)
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.apply).start()


def sessions(parks: DataFrame) -> DataFrame:
    """A stream of open and close events (park_id, event, ts) as intervals, in update mode: a park appears with its start
    when it opens, and again with its end when it closes, however long after. Open parks stay in the state, closed ones
    leave it; a close that comes before its open waits for it."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st, en = state.get if state.exists else (None, None)
        for frame in frames:
            opens, closes = frame.loc[frame["event"] == "open", "us"], frame.loc[frame["event"] == "close", "us"]
            st = st if opens.empty else int(opens.min()) if st is None else min(st, int(opens.min()))
            en = en if closes.empty else int(closes.max()) if en is None else max(en, int(closes.max()))
        if st is not None and en is not None:
            state.remove()
        else:
            state.update((st, en))
        yield pd.DataFrame({"park_id": [key[0]], "st": pd.array([st], dtype="Int64"), "en": pd.array([en], dtype="Int64")})

    events = parks.select("park_id", "event", F.unix_micros("ts").alias("us"))
    paired = events.groupBy("park_id").applyInPandasWithState(run, "park_id string, st bigint, en bigint", "st bigint, en bigint", "update", GroupStateTimeout.NoTimeout)
    return paired.select("park_id", F.timestamp_micros("st").alias("st"), F.timestamp_micros("en").alias("en"))
