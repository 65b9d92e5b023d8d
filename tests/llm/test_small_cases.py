"""Each operator on nulls, empty and very long texts, ties, repeated rows, an empty table and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
ROWS = [
    (1, "The same words here, in this text.", "en", "a", 1),
    (2, "the SAME words here, in this text.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", "b", 9),
    (5, LONG, "en", "b", 9),
    (None, "no id at all", "en", "c", 3),
    (7, " \t\n ", "de", "c", 3),
    (8, "É é ß ẞ 🙂   x", "fr", "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("clash") for c in ("uid", "salt", "key", "item", "node", "copies", "rate")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_context_tree(docs, none):
    from sedimenta.llm.context_tree import scored

    rows = scored(docs, F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 0 for r in rows)
    empty = [r for r in rows if r["doc_id"] in (3, 4, 7)]
    assert {(r["n_tokens"], r["n_known"]) for r in empty} == {(1, 1)} and len({(r["n_bytes"], r["score"]) for r in empty}) == len({r["n_bytes"] for r in empty}) == 2
    untrained = scored(docs, F.lit(False)).collect()
    assert all(abs(r["score"] + 8 * r["n_bytes"] * 0.30102999566) < 1e-3 * r["n_bytes"] and r["n_known"] == 0 for r in untrained)
    assert scored(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("bits", [63, 2])
def test_exact_dedup(docs, none, bits):
    from sedimenta.llm.exact_dedup import exact_duplicates

    rows = exact_duplicates(docs, min_chunk=64, average=256, max_chunk=1024, hash_bits=bits).collect()
    own = {}
    for d, t, *_ in ROWS:
        own.setdefault((t or "").encode().lower(), []).append(d)
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t for t, ids in own.items() if r["doc_id"] in ids]
        assert r["text_sha256"] in {hashlib.sha256(t).hexdigest() for t in texts}
        group = next(ids for t, ids in own.items() if hashlib.sha256(t).hexdigest() == r["text_sha256"])
        keep = max((i for i in group if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), r["doc_id"] == keep)
    assert exact_duplicates(none).count() == 0


def test_chunks_follow_content():
    from sedimenta.llm.exact_dedup import boundaries

    text = LONG.encode()
    for shift in (b"", b"some words before ", b"x" * 5000):
        ends = boundaries(shift + text, 64, 256, 1024)
        cut = [(shift + text)[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(cut) == shift + text and max(map(len, cut)) <= 1024
        if not shift:
            first = set(cut)
        else:
            assert len(first & set(cut)) > 0.95 * len(first)


def test_toxicity(spark, docs, none):
    from sedimenta.llm.toxicity import fit, fitted, scored

    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (4, 1), (9, 1), (None, 1)], "doc_id bigint, toxic int")
    for model in (fit(docs, labels, F.lit(True)), fit(docs, labels, F.lit(False)), fit(none, labels, F.lit(True))):
        rows = scored(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert scored(none, fitted([], [])).count() == 0


def test_toxicity_finds_what_marks_it():
    import random

    from sedimenta.llm.toxicity import fitted

    r = random.Random(3)
    plain = [" ".join(r.choice("alpha beta gamma delta omega sigma theta kappa".split()) + str(r.randrange(50)) for _ in range(60)) for _ in range(400)]
    bad = [t.replace(" ", " dreadful ", 3) for t in plain[:200]]
    score = fitted([t.encode() for t in bad[:150]], [t.encode() for t in plain[200:350]]).scorer()
    assert all(score(t.encode()) > 0.5 for t in bad[150:]) and all(score(t.encode()) < 0.5 for t in plain[350:])


def test_toxicity_passes_over_long_texts(spark):
    """Texts above the byte budget, and some that together fill it, come first in the order and stop nothing."""
    import random

    from sedimenta.llm.toxicity import fit

    r = random.Random(4)
    order = [x[0] for x in spark.range(120).orderBy(F.xxhash64("id")).collect()]
    rows = []
    for k, i in enumerate(order):
        bad = k % 2
        words = ["dreadful" if bad and j % 7 == 3 else f"plain{r.randrange(500)}" for j in range(40)]
        rows.append((i, " ".join(words) + (" much" * 12_000 if k < 2 else " much" * 5_000 if k < 6 else ""), bad))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = fit(df, df, F.lit(True), sample_bytes=50_000)
    score = model.scorer()
    assert model.weights and all((score(t.encode()) > 0.5) == bool(bad) for _, t, bad in rows[6:])
    with pytest.raises(ValueError):
        fit(df, df, F.lit(True), sample_bytes=10)


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sedimenta.llm.packing import packed

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packed(docs, capacity=512).collect()
    expected = []
    for d, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(d, k // 512, k, len(ids[k : k + 512]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 512]))) for k in range(0, len(ids), 512)]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=order) == sorted(expected, key=order)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packed(none).count() == 0


@pytest.mark.parametrize("node_items", [100_000, 40])
def test_packing_is_near_the_bound(spark, node_items):
    import random

    from sedimenta.llm.packing import pack

    r = random.Random(7)
    sizes = [min(100, int(r.expovariate(1 / 30)) + 1) for _ in range(1500)]
    rows = pack(spark.createDataFrame([*enumerate(sizes)], "item bigint, size bigint"), 100, node_items=node_items, fan_in=4).collect()
    assert sorted(x["item"] for x in rows) == list(range(1500))
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], sizes[x["item"]]))
    for own in by.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
    assert len(by) <= 1.03 * sum(sizes) / 100 + 1


def test_near_duplicates(docs, none):
    from sedimenta.llm.parity_join import near_duplicates

    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[1][1] == by[2][1] == 1 and by[3] == (0, 3) and by[4] == (0, 4) and by[7] == (0, 7) and by[None][1] is None and by[5] == (len(LONG.split()) - 4, 5)
    assert near_duplicates(none).count() == 0


def test_mixing(spark, docs, none):
    from sedimenta.llm.mixing import mixed, sized, with_copies

    rows = with_copies(sized(docs)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in rows)
    assert {r["source"]: r["source_size"] for r in rows}[None] == 0
    assert sum({r["source"]: r["target"] for r in rows}.values()) <= 1.5 * sum(r["size"] for r in rows) + 1e-6
    out = mixed(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 5").count() <= 4
    assert with_copies(sized(none)).count() == 0 and mixed(none).count() == 0


def test_surrogates(docs, none):
    from sedimenta.llm.surrogates import with_surrogates

    out = with_surrogates(docs, "k")
    assert {c for c in docs.columns} <= set(out.columns)
    key = lambda r: tuple((v is None, str(v)) for v in (r["doc_id"], r["text"]))
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    assert with_surrogates(none, "k").count() == 0


def test_language(spark, docs, none):
    from sedimenta.llm.language import languages_of

    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang=de><p>und der die das"), (2, None, None), (None, "nonsense", ""), (1, "http://a.de/x", "<html lang=de><p>und der die das")], "page_id bigint, url string, html string").withColumn("uid", F.lit(0))
    rows = languages_of(pages, docs).collect()
    assert len(rows) == 4 and all(r["language"] in ("en", "de", "fr") and 0 < r["probability"] <= 1 for r in rows)
    assert [r["language"] for r in languages_of(pages, none).collect()] == [None] * 4
    assert languages_of(pages.filter("false"), docs).count() == 0
