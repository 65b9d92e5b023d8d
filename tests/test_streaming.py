"""Incremental maintenance equals the whole fold; late and repeated records stop it."""

import json
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException

from sedimenta.schemas import DOCX, JOURNAL
from sedimenta.streaming.catchup import Catchup, OutOfOrder, fold, sessions


def record(i: int, cas: int, media: str = "text/plain") -> dict:
    return {"schema": "journal.v2", "event_id": f"e{i:04d}", "at": f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "event": "ingest", "cas_id": f"sha256:{cas}", "size": cas, "media_type": media, "source_root_id": "s", "original_relpath": f"p{i}", "batch": None if i % 2 else "b", "outcome": "stored"}


def put(folder, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_catch_up_equals_fold(spark, tmp_path):
    source, index = tmp_path / "in", Catchup(spark, str(tmp_path / "index"))
    rows = [record(i, i % 5, "application/zip" if i < 4 else "text/plain" if i % 5 == 4 else DOCX) for i in range(30)]
    for k in range(3):
        put(source, f"{k}.json", rows[10 * k : 10 * k + 10])
        query = index.start(str(source), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
    whole = fold(spark.createDataFrame([tuple(r[f] for f in JOURNAL.fieldNames()) for r in rows], JOURNAL))
    assert sorted(map(tuple, index.index().collect()), key=str) == sorted(map(tuple, whole.select(index.index().columns).collect()), key=str)
    put(source, "late.json", [record(3, 1)])
    with pytest.raises(StreamingQueryException, match="not after"):
        index.start(str(source), str(tmp_path / "checkpoint")).awaitTermination(120)


def test_times_are_compared_as_instants_and_ids_are_known(spark, tmp_path):
    """…00Z, then …00.000001Z, in the next batch; an id that an earlier batch had; a rebuild after it, and a batch after that."""
    index = Catchup(spark, str(tmp_path / "index"))
    batch = lambda *rows: spark.createDataFrame([tuple(r[f] for f in JOURNAL.fieldNames()) for r in rows], JOURNAL)
    first, second = record(1, 1), record(2, 1) | {"at": "2026-01-01T00:00:01.000001Z"}
    index.apply(batch(first), 0)
    index.apply(batch(second), 1)
    known = record(3, 2) | {"event_id": first["event_id"]}
    with pytest.raises(OutOfOrder, match="known"):
        index.apply(batch(known), 2)
    with pytest.raises(OutOfOrder, match="not after"):
        index.apply(batch(record(2, 2) | {"at": second["at"], "event_id": "e0001x"}), 2)
    index.apply(batch(record(2, 2) | {"at": second["at"], "event_id": "e0002x"}), 2)
    late = record(0, 3)
    index.rebuild(batch(late, first, second), 3)
    index.apply(batch(record(9, 3)), 4)
    assert {r["cas_id"]: r["records"] for r in index.index().collect()} == {"sha256:1": 2, "sha256:3": 2}
    with pytest.raises(OutOfOrder, match="known"):
        index.apply(batch(record(10, 3) | {"event_id": late["event_id"]}), 5)


def test_names_and_media_across_batches(spark, tmp_path):
    index = Catchup(spark, str(tmp_path / "index"))
    batch = lambda *rows: spark.createDataFrame([tuple(r[f] for f in JOURNAL.fieldNames()) for r in rows], JOURNAL)
    index.apply(batch(record(1, 1, "application/zip"), record(2, 2)), 0)
    index.apply(batch(record(3, 1, DOCX), record(4, 1, DOCX) | {"original_relpath": "p1"}), 1)
    assert {r["cas_id"]: r["media_type"] for r in index.index().collect()} == {"sha256:1": DOCX, "sha256:2": "text/plain"}
    assert sorted((r["original_relpath"], r["recorded_utc"][-3:]) for r in index.names().collect()) == [("p1", "01Z"), ("p2", "02Z"), ("p3", "03Z")]
    for odd in (record(5, 1, "text/plain"), record(5, 2) | {"size": 9}):
        with pytest.raises(OutOfOrder, match="refinement"):
            index.apply(batch(odd), 2)


def test_sessions_of_any_length(spark, tmp_path):
    """A park of three days, one that stays open, and a close that comes before its open."""
    schema = "park_id string, event string, ts timestamp"
    source, out = str(tmp_path / "parks"), []
    (tmp_path / "parks").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches = [[("long", "open", "2026-01-01"), ("never", "open", "2026-01-01"), ("early", "close", "2026-01-03")], [("long", "close", "2026-01-04")], [("early", "open", "2026-01-02")]]
    for rows in batches:
        spark.createDataFrame(rows, "park_id string, event string, day string").selectExpr("park_id", "event", "CAST(day AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(source)
        query = sessions(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).start()
        query.awaitTermination(120)
    day = lambda d: datetime(2026, 1, d)
    assert {r for r in out if r[1] and r[2]} == {("long", day(1), day(4)), ("early", day(2), day(3))}
    assert ("never", day(1), None) in out and ("long", day(1), None) in out and ("early", None, day(3)) in out
