"""TIFF: a reader that walks image directories and yields one row per page, and a writer for lossless 8-bit samples.

The reader takes both byte orders, offsets of 32 and of 64 bits, strips and tiles, chunky and planar samples of 1, 2, 4, 8,
16 and 32 bits, bytes filled from either end, and the compressions none (1), LZW (5), deflate (8 and 32946) and PackBits
(32773), and undoes the horizontal predictor (2) for samples of 8 bits and more. Samples of less than 8 bits come as a
byte each. Images that a page refers to as its own (thumbnails, reduced sizes) are no pages and are not emitted. A
directory that cannot be read gives one row with `error` set, and the walk goes on with the next where its place is
known; a loop of directories ends the walk. Bytes that are no TIFF, empty or null give one row with `error`.

Rows per page: page, width, height, samples, bits, compression, predictor, tiled, pixels (the samples as stored in
rows, chunky), error. Media are bounded by their column's size; a page's pixels by `max_page_bytes`, beyond which the
page is refused with an error rather than cut.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: tag numbers, the sizes of field types, and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class TiffError(ValueError):
    """What cannot be read, and why."""


def unpack_bits(data: bytes, expected: int) -> bytes:
    out, i, n, size = [], 0, len(data), 0
    while i < n and size < expected:
        c = data[i]
        if c < 128:
            run = data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            run = data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
            continue
        out.append(run)
        size += len(run)
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)


def pack_bits(row: bytes) -> bytes:
    """Runs of three and more are packed, all else is literal; a row at a time."""
    out, n, literal = bytearray(), len(row), 0

    def flush(upto: int) -> None:
        for at in range(literal, upto, 128):
            part = row[at : min(at + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(row):
        i, end = run.span()
        flush(i)
        for at in range(i, end, 128):
            part = min(128, end - at)
            out.extend((257 - part, row[i]) if part > 1 else (0, row[i]))
        literal = end
    flush(n)
    return bytes(out)


_FIRST = [bytes((i,)) for i in range(256)]


def unpack_lzw(data: bytes, expected: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, which grow one code early; strings are read from a table."""
    out, size = [], 0
    table = [*_FIRST, b"", b""]
    bits, held, width, limit, previous = 0, 0, 9, 511, None
    for byte in data:
        bits = (bits << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == CLEAR:
            table = [*_FIRST, b"", b""]
            width, limit, previous = 9, 511, None
            continue
        if code == END:
            break
        if previous is None:
            entry = table[code] if code < 256 else None
            if entry is None:
                raise TiffError("LZW: a string before any character")
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise TiffError("LZW: unknown code")
            table.append(previous + entry[:1])
            if len(table) >= limit and width < 12:
                width += 1
                limit = (1 << width) - 1
        out.append(entry)
        size += len(entry)
        previous = entry
        if size >= expected:
            break
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = []
    table = {b: i for i, b in enumerate(_FIRST)}
    following, width = 258, 9
    codes.append((CLEAR, 9))
    held = b""
    for i in range(len(data)):
        grown = held + data[i : i + 1]
        if grown in table:
            held = grown
            continue
        codes.append((table[held], width))
        table[grown] = following
        following += 1
        if following == 1 << width and width < 12:
            width += 1
        elif following >= 4094:
            codes.append((CLEAR, width))
            table = {b: j for j, b in enumerate(_FIRST)}
            following, width = 258, 9
        held = data[i : i + 1]
    if held:
        codes.append((table[held], width))
        following += 1
        if following == 1 << width and width < 12:
            width += 1
    codes.append((END, width))
    out, bits, n = bytearray(), 0, 0
    for code, w in codes:
        bits = (bits << w) | code
        n += w
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def decompress(data: bytes, compression: int, expected: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, expected)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if compression == PACKBITS:
        return unpack_bits(data, expected)
    if compression == LZW:
        return unpack_lzw(data, expected)
    raise TiffError(f"compression {compression} is not read")


def directories(data: bytes) -> Iterator[tuple[dict[int, list[int]] | None, str | None, str]]:
    """(fields, error, byte order) of each directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 16 else 0
    if magic not in (42, 43):
        raise TiffError("not a TIFF")
    place, number, entry, inline = ("Q", "Q", 20, 8) if magic == 43 else ("I", "H", 12, 4)  # 43: offsets of 64 bits
    width = struct.calcsize(f"{order}{number}")
    at, seen = struct.unpack_from(f"{order}{place}", data, inline)[0], set()
    while at:
        if at in seen:
            yield None, "directories form a loop", order
            return
        seen.add(at)
        try:
            n = struct.unpack_from(f"{order}{number}", data, at)[0]
            if n * entry > len(data):
                raise struct.error
            fields: dict[int, list[int]] = {}
            for k in range(n):
                here = at + width + entry * k
                tag, kind, count = struct.unpack_from(f"{order}HH{place}", data, here)
                size = TYPE_SIZES.get(kind, 0) * count
                if kind not in (1, 3, 4, 16) or size > len(data):
                    continue
                start = here + 4 + inline
                if size > inline:
                    start = struct.unpack_from(f"{order}{place}", data, start)[0]
                fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 16: 'Q'}[kind]}", data, start))
            after = struct.unpack_from(f"{order}{place}", data, at + width + entry * n)[0]
        except struct.error:
            yield None, "a directory is cut off", order
            return
        yield fields, None, order
        at = after


def unpredicted(block: np.ndarray, bits: int, order: str) -> np.ndarray:
    """block: rows, width, bytes of a pixel's samples by sample; differences along a row are summed."""
    if bits == 8:
        return np.cumsum(block, axis=1, dtype=np.uint8)
    unit = bits // 8
    wide = np.cumsum(block.view(f"{order}u{unit}"), axis=1, dtype=f"u{unit}").astype(f"{order}u{unit}")
    return wide.view(np.uint8)


def spread(raw: bytes, rows: int, across: int, bits: int) -> np.ndarray:
    """Rows of samples of less than a byte, each row padded to bytes, as a byte each."""
    packed = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    parts = [(packed >> (8 - bits * (k + 1))) & ((1 << bits) - 1) for k in range(8 // bits)]
    return np.stack(parts, axis=2).reshape(rows, -1)[:, :across]


def decode_page(data: bytes, fields: dict[int, list[int]], order: str, max_page_bytes: int) -> bytes:
    def one(tag: int, default: int | None = None) -> int:
        value = fields.get(tag) or ([default] if default is not None else None)
        if not value:
            raise TiffError(f"tag {tag} is missing")
        return value[0]

    width, height, bits, samples = one(WIDTH), one(HEIGHT), one(BITS, 1), one(SAMPLES, 1)
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or any(b != bits for b in fields.get(BITS, [bits])):
        raise TiffError(f"{bits} bits a sample are not read")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise TiffError(f"predictor {predictor} is not read")
    unit = max(1, bits // 8)
    mirrored = one(FILL_ORDER, 1) == 2
    if width * height * samples * unit > max_page_bytes:
        raise TiffError("the page is larger than max_page_bytes")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_OFFSETS in fields
    if tiled:
        tw, th, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields.get(TILE_COUNTS)
    else:
        tw, th, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), fields.get(STRIP_OFFSETS), fields.get(STRIP_COUNTS)
    if not tw or not th or not offsets:
        raise TiffError("the page has no strips or tiles")
    counts = counts or [len(data)] * len(offsets)
    across, down = -(-width // tw), -(-height // th)
    if min(len(offsets), len(counts)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    page = np.zeros((height, width, samples * unit), np.uint8)
    for p in range(planes):
        for k in range(across * down):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, height - y)
            i = p * across * down + k
            size = rows * -(-tw * deep * bits // 8)
            stored = data[offsets[i] : offsets[i] + counts[i]]
            raw = decompress(stored.translate(MIRRORED) if mirrored else stored, compression, size)
            if len(raw) < size:
                raise TiffError("a strip or tile is cut off")
            samples_of = spread(raw[:size], rows, tw * deep, bits) if bits < 8 else np.frombuffer(raw[:size], np.uint8)
            block = samples_of.reshape(rows, tw, deep * unit)
            if predictor == 2:
                block = unpredicted(np.ascontiguousarray(block), bits, order)
            h, w = min(rows, height - y), min(tw, width - x)
            at = slice(p * unit, (p + 1) * unit) if planes > 1 else slice(None)
            page[y : y + h, x : x + w, at] = block[:h, :w]
    return page.tobytes()


def pages(data: bytes | None, max_page_bytes: int = 1 << 30) -> Iterator[dict]:
    blank = {"page": 0, **dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"))}
    if not data:
        yield blank | {"error": "empty"}
        return
    k = -1
    try:
        for k, (fields, error, order) in enumerate(directories(data)):
            row = blank | {"page": k, "error": error}
            if fields is not None:
                get = lambda tag, default=None: (fields.get(tag) or [default])[0]  # noqa: B023, E731
                row |= {"width": get(WIDTH), "height": get(HEIGHT), "samples": get(SAMPLES, 1), "bits": get(BITS, 1), "compression": get(COMPRESSION, 1), "predictor": get(PREDICTOR, 1), "tiled": TILE_OFFSETS in fields}
                try:
                    row["pixels"] = decode_page(data, fields, order, max_page_bytes)
                except (TiffError, ValueError, IndexError) as e:
                    row["error"] = str(e)
            yield row
        if k < 0:
            yield blank | {"error": "no directory"}
    except TiffError as e:
        yield blank | {"page": k + 1, "error": str(e)}


def write(images: list[tuple[np.ndarray, int, int, tuple[int, int] | None]], order: str = "<") -> bytes:
    """images: (rows x width x samples of uint8, compression, predictor, tile (width, height) or None for strips of 16 rows)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image, compression, predictor, tile in images:
        height, width, samples = image.shape
        tw, th = tile or (width, 16)
        offsets, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile and block.shape[:2] != (th, tw):
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                raw = np.ascontiguousarray(block).tobytes()
                if compression == DEFLATE:
                    raw = zlib.compress(raw, 1)
                elif compression == PACKBITS:
                    step = block.shape[1] * samples
                    raw = b"".join(pack_bits(raw[r : r + step]) for r in range(0, len(raw), step))
                elif compression == LZW:
                    raw = pack_lzw(raw)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        out += b"\0" * (len(out) % 2)
        many = [(BITS, 3, [8] * samples), *([(TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (STRIP_COUNTS, 4, counts)])]
        single = [(WIDTH, width), (HEIGHT, height), (COMPRESSION, compression), (PHOTOMETRIC, 1 if samples == 1 else 2), (SAMPLES, samples), (PLANAR, 1), (PREDICTOR, predictor)]
        single += [(TILE_WIDTH, tw), (TILE_HEIGHT, th)] if tile else [(ROWS_PER_STRIP, th)]
        entries = []
        for tag, kind, values in sorted([*many, *((t, 4, [v]) for t, v in single)]):
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(f"{order}I", at)
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_ROW = "media_id bigint, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
_PAGE_ARROW = pa.schema(
    [("media_id", pa.int64()), *((c, pa.int32()) for c in ("page", "width", "height", "samples", "bits", "compression", "predictor")), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
)


def tiff_pages(media: DataFrame, max_page_bytes: int = 1 << 30) -> DataFrame:
    """media: media_id, content. One row per page, as PAGE_ROW says; a row at a time is decoded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media_id, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in pages(content.as_py(), max_page_bytes):
                    yield pa.RecordBatch.from_pylist([row | {"media_id": media_id.as_py()}], schema=_PAGE_ARROW)

    return media.select("media_id", "content").mapInArrow(read, PAGE_ROW)
