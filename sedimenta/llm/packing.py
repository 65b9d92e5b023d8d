"""Best-fit packing by hierarchical residuals.

Documents are tokenized, cut only where they are longer than a sequence, and the pieces packed: each node packs its own
pieces by best-fit decreasing and emits the bins that are nearly full (at most 1 / `nearly` of a sequence is left); the
underfull ones become items of the next round, in which `fan_in` nodes meet in one, until one node is left.

A node also emits underfull bins beyond its `carry` emptiest, which costs no sequence: two bins can only be merged if
one of them is half full or less, and after a node has packed at most one such bin is left (two would have been merged).
So fan_in nodes that meet bring fan_in such bins at most, on any way to the root no more than fan_in times the rounds
need a host, and if a bin fits anywhere it fits in the emptiest host. `carry` must be at least that product, which is
checked; it bounds what meets in a task where nothing can be merged (say, all pieces just over half a sequence).

Only lengths move between rounds: a bin is an item with a size, its members are found by joining the rounds' small
tables. Tokenization remembers the ids of words (white space always ends a word, so the words of a text can be encoded
one by one), in a bounded memory per worker.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are documents of their own; a null
doc_id stays null; an empty table gives no row. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import persisted, utf8

PIECES = "doc_id bigint, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: A word of Latin letters with punctuation around it; an apostrophe may begin a contraction and is left to the tokenizer.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_MEMORY: dict[str, tuple[object, dict[bytes, bytes]]] = {}
MEMORY_WORDS, MEMORY_WORD_BYTES = 600_000, 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return [chr(b) if b in printed else chr(256 + others.index(b)) for b in range(256)]


def word_encoder(path: str):
    """A function from a text's bytes to its ids, 4 bytes each, little-endian; the memory lives as long as the worker.

    White space (the six ASCII characters) always ends a word, so words are encoded one by one and remembered. In a word
    of Latin letters with punctuation around it, the letters and each run of punctuation are units of the tokenizer's own
    pattern, so the letters go to its model directly; any other word goes through the whole tokenizer.
    """
    if path not in _MEMORY:
        from tokenizers import Tokenizer

        _MEMORY[path] = (Tokenizer.from_file(path), {})
    tokenizer, memory = _MEMORY[path]
    model, letter = tokenizer.model, _byte_letters()

    def whole(word: bytes) -> bytes:
        return _packed(tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def missing(word: bytes) -> bytes:
        plain = None if b"<|" in word else _PLAIN.fullmatch(word.decode("utf-8", "replace"))
        if not plain:
            return whole(word)
        out = []
        for k, unit in enumerate(plain.groups()):
            if unit:
                raw = unit.lower().encode()
                ids = memory.get(raw)
                if ids is None:
                    ids = _packed([t.id for t in model.tokenize("".join(map(letter.__getitem__, raw)))]) if k == 1 else whole(raw)
                    memory[raw] = ids
                out.append(ids)
        return b"".join(out)

    def encode(text: bytes) -> bytes:
        if b"<|" not in text:  # strings of special tokens are told by their case
            text = text.lower()
        words = text.split()
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        long = {}
        for word in set(words).difference(memory):
            (memory if len(word) <= MEMORY_WORD_BYTES else long)[word] = missing(word)
        if long:
            return b"".join([memory[w] if w in memory else long[w] for w in words])
        return b"".join(map(memory.__getitem__, words))

    return encode


def pieces(documents: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, uid (one per row of documents), piece, start, length, ids_crc32."""
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, uid, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", F.monotonically_increasing_id().alias("uid"), utf8().alias("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, best-fit decreasing; ties keep their order. Open bins are held by what they have left."""
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_left = 0  # bit r is set if a bin has r left
    filled: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        above = open_left >> size
        if above and size:
            left = size + (above & -above).bit_length() - 1
            b = by_left[left].pop()
            if not by_left[left]:
                open_left &= ~(1 << left)
        else:
            left, b = capacity, len(filled)
            filled.append(0)
        places[i] = (b, filled[b])
        filled[b] += size
        if left > size:
            by_left[left - size].append(b)
            open_left |= 1 << (left - size)
    return places


ROUND = "item bigint, bin bigint, offset bigint, size bigint, done boolean"


def pack(items: DataFrame, capacity: int = 2048, node_items: int = 100_000, fan_in: int = 8, carry: int = 4096, nearly: int = 64) -> DataFrame:
    """items: item (unique), size (1 to capacity). Returns item, sequence_id, offset."""

    def node(root: bool):
        def run(key: tuple, own: pa.Table) -> pa.Table:
            own = own.sort_by([("size", "descending"), ("item", "ascending")])
            ids, sizes = own["item"].to_pylist(), own["size"].to_pylist()
            places = best_fit(sizes, capacity)
            totals: dict[int, int] = {}
            first: dict[int, int] = {}
            for i, (b, _) in enumerate(places):
                totals[b] = totals.get(b, 0) + sizes[i]
                first.setdefault(b, ids[i])  # a bin is named by its largest item, so names stay unique
            underfull = [] if root else [b for b, n in totals.items() if (capacity - n) * nearly > capacity]
            passed = set(sorted(underfull, key=lambda b: (totals[b], first[b]))[:carry])
            return pa.table(
                {"item": ids, "bin": [first[b] for b, _ in places], "offset": [o for _, o in places], "size": [totals[b] for b, _ in places], "done": [b not in passed for b, _ in places]},
                schema=pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("done", pa.bool_())]),
            )

        return run

    items = items.select("item", "size")
    nodes = max(1, -(-items.count() // node_items))
    if carry < fan_in * nodes.bit_length():  # at least as many as there are rounds
        raise ValueError(f"carry must be at least {fan_in * nodes.bit_length()}")
    waiting, rounds = items.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes))), []
    while True:
        packed = persisted(waiting.groupBy("node").applyInArrow(node(nodes == 1), ROUND), "packed")
        rounds.append(packed)
        if nodes == 1:
            break
        nodes = -(-nodes // fan_in)
        waiting = packed.filter("NOT done").select(F.col("bin").alias("item"), "size").distinct().withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes)))
    placed = rounds[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for lower in reversed(rounds[:-1]):
        upper = placed.withColumnsRenamed({"item": "__bin", "sequence_id": "__sequence", "offset": "__offset"})
        placed = lower.join(upper, F.col("bin") == F.col("__bin"), "left").select("item", F.coalesce("__sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("__offset", F.lit(0))).alias("offset"))
    return placed


def packed(documents: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """documents: doc_id, text. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    own = persisted(pieces(documents, capacity, vocabulary, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = own.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pack(own.filter(F.col("length") < capacity).select("item", F.col("length").alias("size")), capacity)
    return own.join(full.unionByName(rest), "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
