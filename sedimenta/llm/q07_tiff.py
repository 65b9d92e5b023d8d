"""op7: every document's bytes as a TIFF, read back.

The payload is an image of one 8-bit sample, 576 pixels wide, in pages of up to 64 rows. A page's coding follows from the
payload's crc32 and the page's number, so equal texts have equal files: deflate in strips with the predictor, deflate in
tiles, PackBits in strips, and LZW for one page in eight.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import table, utf8
from sedimenta.llm.tiff import DEFLATE, LZW, PACKBITS, pages, write

UNIT, ROWS = 576, 64
CODINGS = ((DEFLATE, 2, None), (PACKBITS, 1, None), (DEFLATE, 1, (64, 16)), (LZW, 2, None), (DEFLATE, 2, None), (PACKBITS, 1, (64, 16)), (DEFLATE, 2, (192, 32)), (PACKBITS, 1, None))
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def stored(payload: bytes) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, UNIT, 1)
    first = zlib.crc32(payload)
    return write([(image[y : y + ROWS], *CODINGS[(first + k) % len(CODINGS)]) for k, y in enumerate(range(0, len(image), ROWS))])


def features(text: bytes) -> tuple[int, int, str, int, int, str, str]:
    n = len(text)
    media = stored(text + b"\xff" * (-n % UNIT or (0 if n else UNIT)))
    read, sums = [], np.zeros(256, np.int64)
    for page in pages(media):
        if page["error"]:
            raise ValueError(page["error"])
        read.append(page["pixels"])
        sums += np.bincount(np.frombuffer(page["pixels"], np.uint8), minlength=256)
    back = b"".join(read)
    total, levels = int(sums.sum()), np.arange(256)
    mean = float((sums * levels).sum()) / total
    share = sums[sums > 0] / total
    feature = f"pages={len(read)};width={UNIT};height={total // UNIT};mean={mean:.4f};deviation={float(np.sqrt((sums * (levels - mean) ** 2).sum() / total)):.4f};bits={abs(float((share * np.log2(share)).sum())):.4f}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return table(spark, sf_dir, "documents").select("doc_id", utf8().alias("text")).mapInArrow(run, FEATURES)


#: Encoded files have no SQL form; tests hold the round trip against the payload.
QUERIES = {"op7_tiff": op7_tiff}
ORACLES: dict[str, str] = {}
