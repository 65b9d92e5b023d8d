"""Schemas, grammars and limits of the journal, the tree and the traces."""

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


JOURNAL = _schema(schema=_S, event_id=_S, at=_S, event=_S, cas_id=_S, size=_L, media_type=_S, source_root_id=_S, original_relpath=_S, batch=_S, outcome=_S)
OBJECTS = _schema(cas_id=_S, size=_L, media_type=_S, stored_relpath=_S, first_seen_utc=_S, batch=_S)
V1_JOURNAL = _schema(at=_S, event=_S, cas_id=_S, size=_L, media_type=_S, source_root_id=_S, original_relpath=_S, mtime=_S, batch=_S, outcome=_S)
NAMES = _schema(cas_id=_S, source_root_id=_S, original_relpath=_S, recorded_utc=_S)
REMOTES = _schema(cas_id=_S, remote=_S, key=_S, uploaded_utc=_S, checksum_verified_utc=_S)
ENTRIES = _schema(entry_id=_S, kind=_S, parent_id=_S, name=_S, metadata=_S, cas_id=_S, size=_L, changed_revision=_L, live=_I, comparison_key=_S, touched_revision=_L)

# Grammars and limits.
CAS_ID = r"^sha256:[0-9a-f]{64}$"
JOURNAL_SCHEMA, SNAPSHOT_SCHEMA = "journal.v2", "namespace_snapshot.v1"
UUID4 = r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
EVENT_ID = rf"^(?:uuid:{UUID4}|v1:[0-9]{{16}}:sha256:[0-9a-f]{{64}})$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"
SAFE_INTEGER = (1 << 53) - 1
MOST_ENTRIES, MOST_MANIFEST_BYTES, MOST_PAGE, NAME_BYTES = 100_000, 64 << 20, 10_000, 255
DOCX, XLSX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
REFINEMENTS = (("application/zip", DOCX), ("application/zip", XLSX))
