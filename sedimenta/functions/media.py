"""Media types by their first bytes, and what a zip package holds."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.schemas import DOCX, XLSX

# First bytes and the types they stand for.
MAGIC = (
    (b"%PDF-", "application/pdf"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b", "application/gzip"),
    (b"II*\x00", "image/tiff"),
    (b"MM\x00*", "image/tiff"),
)


def ooxml_type(content: bytes) -> str | None:
    """docx or xlsx by the package's members; None for any other zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = set(z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
    if "[Content_Types].xml" not in members:
        return None
    word, sheet = "word/document.xml" in members, "xl/workbook.xml" in members
    return DOCX if word and not sheet else XLSX if sheet and not word else None


def media_type(content: bytes) -> str:
    if not content:
        return "application/x-empty"
    for first, kind in MAGIC:
        if content.startswith(first):
            return (ooxml_type(content) or kind) if kind == "application/zip" else kind
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if any(ord(c) < 32 and c not in "\t\n\r\f" for c in text):
        return "application/octet-stream"
    return "application/json" if text.lstrip()[:1] in ("{", "[") else "text/plain"


@F.pandas_udf(T.StringType())
def media_type_udf(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if c is None else media_type(bytes(c)))
