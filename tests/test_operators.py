"""Operators against naive versions, algebraic laws and hand-computed values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.media import media_type, ooxml_type
from sedimenta.functions.names import canonical_bytes, comparison_key, strings_in
from sedimenta.functions.scalars import boot_seconds, elapsed, nanoseconds, phase_order, same_boot
from sedimenta.operators import chains, excise, intervals, onboard, snapshots, tree, validate, verify
from sedimenta.plans import composites

SPAN = "g bigint, span_id bigint, category string, depth int, attempt int, outcome string, st bigint, en bigint"


def random_spans(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        st = r.randrange(0, 60)
        out.append((r.randrange(4), i, r.choice("abc"), r.randrange(3), 1, "ok", st, st + r.choice([0, 1, 3, 9, 20])))
    return out


def naive_exclusive(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[7] > r[6]]
        cuts = sorted({t for r in own for t in r[6:8]})
        for a, b in zip(cuts, cuts[1:], strict=False):
            over = [r for r in own if r[6] <= a and r[7] >= b]
            if over:
                best = max(over, key=lambda r: (r[3], -(r[7] - r[6]), r[1]))
                out[g, best[2]] = out.get((g, best[2]), 0) + b - a
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_naive(spark, seed):
    rows = random_spans(120, seed)
    df = spark.createDataFrame(rows, SPAN)
    unions = {r["g"]: r["union_length"] for r in intervals.union_length(df).collect()}
    peaks = {r["g"]: r["peak"] for r in intervals.peak_concurrency(df).collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        covered = {t for r in own for t in range(r[6], r[7])}
        assert unions[g] == len(covered)
        assert peaks[g] == max([sum(r[6] <= t < r[7] for r in own) for t in range(100)])
    found = {(r["g"], r["category"]): r["exclusive"] for r in intervals.exclusive(df, bucket=7).collect()}
    assert found == naive_exclusive(rows)


def test_exclusive_time_of_one_dense_group_needs_no_pairs(spark):
    n = 20_000  # all in one group and bucket, each open with the 10,000 before it; pairs of spans and segments are 400 million
    df = spark.range(n).selectExpr("1 AS g", "id AS span_id", "concat('c', id % 3) AS category", "CAST(id % 5 AS INT) AS depth", "1 AS attempt", "'ok' AS outcome", "id * 10 AS st", "id * 10 + 100000 AS en")
    plan = intervals.exclusive(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    found = {r["category"]: r["exclusive"] for r in intervals.exclusive(df).collect()}
    rows, expected = [(i % 5, i, i * 10) for i in range(n)], {}
    deepest = [r for r in rows if r[0] == 4]  # all as long; of the deepest that are open the last one wins, before the first and after the last the others do
    for k, (_, i, st) in enumerate(deepest):
        end = min(deepest[k + 1][2] if k + 1 < len(deepest) else st + 100_000, st + 100_000)
        expected[f"c{i % 3}"] = expected.get(f"c{i % 3}", 0) + end - st
    for depth, st, end in ((0, 0, 10), (1, 10, 20), (2, 20, 30), (3, 30, 40)):
        expected[f"c{depth % 3}"] = expected.get(f"c{depth % 3}", 0) + end - st
    assert found == expected


@pytest.mark.parametrize("label", ["category", "role"])
def test_exclusive_keeps_odd_keys_apart(spark, label):
    df = spark.sql("SELECT * FROM VALUES (struct(1, 'a'), 'x', 0, 0L, 10L), (struct(1, 'a'), NULL, NULL, 5L, 12L), (struct(1, CAST(NULL AS STRING)), NULL, 1, 0L, 4L), (NULL, 'y', 1, 0L, 3L), (struct(1, 'a'), 'z', 9, 4L, 4L) AS t(g, category, depth, st, en)").withColumn("span_id", F.concat(F.lit("s"), "st")).withColumnRenamed("category", label)
    found = {(r["g"]["col1"], r["g"]["col2"], r[label]): r["exclusive"] for r in intervals.exclusive(df, label=label).collect()}
    assert found == {(1, "a", "x"): 10, (1, "a", None): 2, (1, None, None): 4}


def test_group_of_two_reviewers(spark):
    df = spark.createDataFrame([(1, 1, "p", 1, 1, "ok", 10, 70), (1, 2, "r", 1, 2, "error", 40, 90)], SPAN)
    row = intervals.group_metrics(df).first()
    assert (row["members"], row["summed"], row["window"], row["union_length"], row["overlap"], row["peak"], row["ratio"]) == (2, 110, 80, 80, 30, 2, 1.375)


def test_parks(spark):
    second = 1_000_000
    rows = [("a", 1, "open", 1 * second, 1, 1), ("b", 1, "open", 6 * second, 1, 2), ("a", 1, "close", 11 * second, 1, 3), ("b", 1, "close", 16 * second, 1, 4)]
    schema = "park_id string, phase_id bigint, event string, at bigint, boot bigint, ord bigint"
    row = intervals.park_summary(spark.createDataFrame(rows, schema)).first()
    assert (row["total"], row["method"]) == (15 * second, "exact-union")
    crossing = [*rows, ("c", 1, "open", 100 * second, 1, 5), ("c", 1, "close", 160 * second, 2, 6)]
    row = intervals.park_summary(spark.createDataFrame(crossing, schema)).first()
    assert (row["total"], row["method"]) == (75 * second, "calendar-union-cross-boot")
    row = intervals.park_summary(spark.createDataFrame(rows[:3], schema)).first()
    assert (row["total"], row["method"]) == (None, "incomplete")
    faulty = spark.createDataFrame([("a", 1, "close", 1, 1, 1), ("b", 1, "open", 1, 1, 2), ("b", 1, "open", 2, 1, 3)], schema)
    assert {(r["park_id"], r["fault"]) for r in intervals.park_errors(faulty).collect()} == {("a", "close without open"), ("b", "duplicate open")}


def test_union_laws(spark):
    r = random.Random(5)
    events = [(f"e{i}", f"c{r.randrange(9)}", i) for i in range(60)]
    a, b, c = (spark.createDataFrame([e for e in events if r.random() < 0.6] or events[:1], "event_id string, cas_id string, size bigint") for _ in range(3))
    rows = lambda df: sorted(map(tuple, df.collect()))
    union = verify.merge_union
    assert rows(union(a, b)) == rows(union(b, a))
    assert rows(union(union(a, b), c)) == rows(union(a, union(b, c)))
    assert rows(union(a, a)) == rows(a)
    assert verify.merge_conflicts(a, b).isEmpty()
    changed = b.withColumn("size", F.col("size") + 1)
    with pytest.raises(composites.MergeRefused):
        composites.merge(b, changed)


def test_verify_precedence(spark):
    statuses = lambda *s: spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "cas_id string, status string")
    assert verify.exit_code(statuses("ok", "ok")) == 0
    assert verify.exit_code(statuses("ok", "writable"), drifted=True) == 10
    assert verify.exit_code(statuses("missing", "writable")) == 11
    assert verify.exit_code(statuses("ok"), drifted=True) == 12
    same = dict(store_id="a", lineage_id="l", epoch_id="e", generation=1, predecessor_epoch_id=None)
    assert verify.same_epoch(same, same) == "same-store"
    assert verify.same_epoch(same, same | {"store_id": "b"}) is None
    assert verify.same_epoch(same, same | {"store_id": "b", "generation": 2}) == "generation-mismatch"


def test_bag_difference_counts_repeats(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "cas_id string")
    b = spark.createDataFrame([("x",), ("z",)], "cas_id string")
    assert {tuple(r) for r in verify.bag_difference(a, b).collect()} == {("x", "stored", 1), ("y", "stored", 1), ("z", "folded", 1)}


def test_mutations(spark):
    log = tree.MutationLog(spark)
    log.execute("t1", "create-directory", entry_id="d", parent_id="/", name="Docs")
    log.execute("t2", "create-file", entry_id="f", parent_id="d", name="a.txt", cas_id="sha256:1", size=3)
    assert log.execute("t2", "create-file", entry_id="f", parent_id="d", name="a.txt", cas_id="sha256:1", size=3) == 2
    for args, code in (
        (("t2", "create-file", None, dict(entry_id="g", parent_id="d", name="b", cas_id="c", size=1)), "operation-conflict"),
        (("t3", "create-file", None, dict(entry_id="g", parent_id="d", name="A.TXT", cas_id="c", size=1)), "name-taken"),
        (("t3", "set-metadata", 1, dict(entry_id="f", metadata="{}")), "revision-conflict"),
        (("t3", "delete-entry", None, dict(entry_id="d")), "not-empty"),
        (("t3", "relocate", None, dict(entry_id="d", parent_id="d", name="x")), "inside-itself"),
        (("t3", "replace-content", None, dict(entry_id="d", cas_id="x", size=1)), "not-a-file"),
        (("t3", "duplicate", None, dict(entry_id="d", parent_id="/", name="Copy", ids={"d": "d2"})), "mapping"),
    ):
        token, kind, expected, given = args
        with pytest.raises(tree.Refusal, match=code):
            log.execute(token, kind, expected, **given)
    assert log.execute("t4", "duplicate", entry_id="d", parent_id="/", name="Copy", ids={"d": "d2", "f": "f2"}) == 3
    assert log.execute("t5", "delete-subtree", entry_id="d") == 4
    log.execute("t6", "replace-content", entry_id="f2", cas_id="sha256:2", size=9)
    log.execute("t7", "import-folder", rows=(("i", "directory", "/", "In", "{}", None, None), ("j", "file", "i", "x", "{}", "sha256:3", 1)))
    with pytest.raises(tree.Refusal, match="parent-not-directory"):
        log.execute("t8", "import-folder", rows=(("k", "file", "nowhere", "x", "{}", "sha256:3", 1),))
    live = {r["entry_id"]: r["cas_id"] for r in log.state().filter("live = 1").collect()}
    assert live == {"/": None, "d2": None, "f2": "sha256:2", "i": None, "j": "sha256:3"}
    assert {r["entry_id"] for r in log.state(3).filter("live = 1").collect()} == {"/", "d", "f", "d2", "f2"}
    assert [r["entry_id"] for r in tree.resolve(log.state(), ["copy", "A.txt"]).collect()] == ["f2"]
    assert tree.orphans(log.state()).isEmpty()


def test_names_compare_by_folded_form(spark):
    log = tree.MutationLog(spark)
    log.execute("1", "create-directory", entry_id="a", parent_id="/", name="Straße")
    log.execute("2", "create-directory", entry_id="b", parent_id="/", name="e\u0301")
    for name in ("STRASSE", "É"):
        with pytest.raises(tree.Refusal, match="name-taken"):
            log.execute("3", "create-directory", entry_id="c", parent_id="/", name=name)
    assert [r["entry_id"] for r in tree.resolve(log.state(), ["strasse"]).collect()] == ["a"]
    again = tree.MutationLog(spark, path=log.path)
    assert again.revision == 2 and again.execute("2", "create-directory", entry_id="b", parent_id="/", name="e\u0301") == 2
    names = spark.createDataFrame([("a", "/", "Straße", 1), ("b", "/", "strasse", 1), ("c", "/", "x", 1)], "entry_id string, parent_id string, name string, live int")
    assert [(r["comparison_key"], r["n"]) for r in tree.sibling_conflicts(names).collect()] == [("strasse", 2)]
    from sedimenta.operators.lookup import directory_page

    page = directory_page(names.withColumn("kind", F.lit("file")), "/", "STRASSD", 1).collect()
    assert [(r["entry_id"], r["next_name"]) for r in page] == [("a", "Straße")]


def test_deep_and_odd_trees(spark):
    """A chain of 300 levels, a cycle, an entry without its parent, a file as a parent."""
    chain = [("e0", "directory", None, None)] + [(f"e{i}", "directory", f"e{i - 1}", f"n{i}") for i in range(1, 300)]
    odd = [("x", "directory", "y", "x"), ("y", "directory", "x", "y"), ("z", "file", "nowhere", "z"), ("f", "file", "e2", "f"), ("g", "file", "f", "g")]
    df = spark.createDataFrame(chain + odd, "entry_id string, kind string, parent_id string, name string").withColumn("live", F.lit(1))
    found = {r["entry_id"]: (r["depth"], r["path"]) for r in tree.paths(df).collect()}
    assert len(found) == 302 and found["e299"] == (299, "".join(f"/n{i}" for i in range(1, 300))) and found["g"] == (4, "/n1/n2/f/g")
    below = {r["entry_id"]: r["level"] for r in tree.closure(df, "e150").collect()}
    assert below == {f"e{150 + i}": i for i in range(150)}
    assert {r["entry_id"] for r in tree.closure(df, "x").collect()} == {"x", "y"} and {r["entry_id"] for r in tree.closure(df, "e2").collect()} == {f"e{i}" for i in range(2, 300)} | {"f"}
    assert {r["entry_id"] for r in tree.orphans(df).collect()} == {"x", "y", "z"}
    up = tree.ancestors(df, df.filter("entry_id IN ('e3', 'x', 'z')"))
    assert {(r["entry_id"], r["ancestor_id"], r["level"]) for r in up.collect()} == {("e3", "e3", 0), ("e3", "e2", 1), ("e3", "e1", 2), ("e3", "e0", 3), ("x", "x", 0), ("x", "y", 1), ("z", "z", 0), ("z", "nowhere", 1)}


def test_disclosures_of_long_chains(spark):
    edges = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(70)], "owner string, cas_id string")
    assert excise.disclosures(spark.createDataFrame([("c0",)], "cas_id string"), edges).count() == 71


def test_rational_order(spark):
    from sedimenta.functions.scalars import rational_order

    ratios = [(1, 3), (333_333_333_333_333_333, 10**18), (-1, 3), (7, 2), (10**17, 3 * 10**17 - 1), (2, 6), (9_007_199_254_740_993, 2), (9_007_199_254_740_992, 2)]
    from fractions import Fraction

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ratios)], "i bigint, n bigint, d bigint").withColumn("key", rational_order(F.col("n"), F.col("d")))
    got = [Fraction(r["n"], r["d"]) for r in df.orderBy("key", "i").collect()]
    assert got == sorted(got) and df.select("key").distinct().count() == 7


def test_union_in_buckets_is_the_same(spark):
    df = spark.createDataFrame(random_spans(150, 9), SPAN)
    one = {r["g"]: r["union_length"] for r in intervals.union_length(df).collect()}
    assert one == {r["g"]: r["union_length"] for r in intervals.union_length(df, bucket=7).collect()}


def test_entry_errors(spark):
    rows = [("a", "file", "/", "ok.txt", 1, 1), ("b", "file", "/", "a/b", 1, 1), ("c", "link", "/", "", None, 2), ("d", "directory", "/", "x" * 256, 5, 1), ("e", "file", "/", "e\u0301", 1, 1), ("f", "file", "/", "a\x85", 1, 1)]
    df = spark.createDataFrame(rows, "entry_id string, kind string, parent_id string, name string, size bigint, live int")
    found = {r["entry_id"]: set(r["errors"]) for r in tree.entry_errors(df).collect()}
    assert found == {"b": {"name-characters"}, "c": {"kind", "name-missing", "live"}, "d": {"name-length", "content"}, "e": {"name-form"}, "f": {"name-characters"}}


def test_strict_lines(spark):
    good = '{"schema":"journal.v2","event_id":"uuid:123e4567-e89b-42d3-a456-426614174000","at":"2026-01-01T00:00:00Z","event":"ingest","cas_id":"sha256:%s","size":1,"media_type":"text/plain","source_root_id":"s","original_relpath":"a/b","batch":null,"outcome":"stored"}' % ("0" * 64)
    lines = [good, good.replace('"size":1', '"size":true'), good.replace('"batch":null', '"batch":null,"more":1'), good.replace('"batch":null,', ""), good.replace('"size":1', '"size":1,"size":2'), "[1]", "{", good.replace("a/b", "a/../b"), good.replace("00Z", "00+00:00"), good.replace('"size":1', '"size":1.5')]
    df = spark.createDataFrame([*enumerate(lines)], "ord bigint, line string")
    records, errors = validate.parsed(df)
    found = {r["ord"]: r["errors"] for r in errors.collect()}
    assert 0 not in found and set(found) == set(range(1, len(lines)))
    for bad_id in ("123e4567-e89b-42d3-a456-426614174000", "v1:0000000000000001", "uuid:123e4567-e89b-12d3-a456-426614174000"):
        odd = good.replace("uuid:123e4567-e89b-42d3-a456-426614174000", bad_id)
        assert [r["errors"] for r in validate.parsed(spark.createDataFrame([(0, odd)], "ord bigint, line string"))[1].collect()] == ["event-id"]
    migrated = good.replace("uuid:123e4567-e89b-42d3-a456-426614174000", "v1:0000000000000001:sha256:" + "a" * 64)
    assert validate.parsed(spark.createDataFrame([(0, migrated)], "ord bigint, line string"))[1].isEmpty()
    assert found[1] == "size" and found[2] == "keys" and found[3] == "keys" and found[7] == "relpath" and found[8] == "time"


def test_names_and_canonical_forms():
    assert comparison_key("Straße") == comparison_key("STRASSE")
    assert comparison_key("é") == comparison_key("É")
    assert canonical_bytes('{"b":1,"a":"é"}') == '{"a":"é","b":1}\n'.encode()
    assert canonical_bytes('{"a\\n":"\\u0001\\t\\"\\\\n/\\u007f"}') == b'{"a\\u000a":"\\u0001\\u0009\\"\\\\n/\x7f"}\n'
    for bad in ('{"a":1,"a":2}', "1.5", str(1 << 53), "[" * 70 + "]" * 70):
        with pytest.raises(ValueError):
            canonical_bytes(bad)
    assert strings_in('{"a":["b",{"c":"d"},1,null]}') == ["a", "b", "c", "d"]


def test_media_types():
    import io
    import zipfile

    def package(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for m in members:
                z.writestr(m, "x")
        return out.getvalue()

    assert media_type(b"") == "application/x-empty" and media_type(b"hi") == "text/plain" and media_type(b"\xff\x00") == "application/octet-stream"
    assert ooxml_type(package("[Content_Types].xml", "word/document.xml")).endswith("wordprocessingml.document")
    assert ooxml_type(package("a.txt")) is None and media_type(package("a.txt")) == "application/zip"


def test_scalars(spark):
    row = spark.sql("SELECT '2026-01-02T03:04:05.123456789Z' AS at, 3723000000000 AS ns, 'sec = 100 x' AS a, 'sec = 104' AS b, 'other' AS c").select(
        nanoseconds(F.col("at")).alias("n"), elapsed(F.col("ns")).alias("e"), boot_seconds(F.col("a")).alias("s"), same_boot(F.col("a"), F.col("b")).alias("near"), same_boot(F.col("a"), F.col("c")).alias("far")
    ).first()
    assert row["n"] == 1767323045123456789 and row["e"] == "1h 02m 03s" and row["s"] == 100 and row["near"] and not row["far"]
    phases = spark.createDataFrame([("10",), ("2",), ("2.1",), ("alpha",)], "p string").orderBy(phase_order(F.col("p")))
    assert [r["p"] for r in phases.collect()] == ["2", "2.1", "10", "alpha"]


def test_globs(spark):
    import fnmatch
    import re

    for glob in ("a*", "*.t?t", "[ab]c", "[!ab]c", "x.y", "a[b"):
        for name in ("a", "abc", "q.txt", "ac", "cc", "xzy", "x.y", "a[b"):
            assert bool(re.search(chains.glob_to_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_disclosures_close(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("a", "c")], "owner string, cas_id string")
    start = spark.createDataFrame([("a",)], "cas_id string")
    assert {r[0] for r in excise.disclosures(start, edges).collect()} == {"a", "b", "c"}


def test_redaction_and_controls(spark):
    manifest = spark.sql("SELECT 's' AS snapshot_id, array(named_struct('entry_id', '1', 'cas_id', 'x'), named_struct('entry_id', '2', 'cas_id', 'y')) AS entries")
    row = excise.redacted(manifest, spark.createDataFrame([("x",)], "cas_id string")).first()
    assert row["removed"] == 1 and [e["entry_id"] for e in row["entries"]] == ["2"]
    contents = spark.createDataFrame([("a", '{"schema":"snap/1"}'), ("b", "{"), ("c", '["snap/1"]')], "id string, content string")
    assert [r["id"] for r in onboard.control_documents(contents, "snap/1").collect()] == ["a"]


def test_frames_and_proofs(spark):
    import hashlib

    from sedimenta.sources import framing

    data = 'a\r\nbé\n\n\u2028x\x0by\x85z\rlast'.encode()
    files = spark.createDataFrame([("j", bytearray(data)), ("bad", bytearray(b"\xff\n")), ("empty", bytearray(b""))], "path string, content binary")
    frames = framing.framed(files)
    rows = sorted((r["offset"], r["length"], r["line"]) for r in frames.filter("path = 'j'").collect())
    assert "".join(x for _, _, x in rows).encode() == data and [x for _, _, x in rows] == data.decode().splitlines(keepends=True)
    assert all(framing_bytes == data[o : o + n] for (o, n, x) in rows for framing_bytes in [x.encode()])
    proofs = framing.proven(frames.drop("line"), files).collect()
    assert all(r["proven"] and hashlib.sha256(r["found"]).hexdigest() == r["sha256"] for r in proofs)
    moved = framing.proven(frames.filter("path = 'j'").withColumn("offset", F.col("offset") + 1), files)
    assert not any(r["proven"] for r in moved.collect())
    assert {r["path"]: (r["line"], r["terminated"]) for r in framing.tail(frames).collect()} == {"j": ("last", False), "bad": (None, False)}


def test_first_format(spark, tmp_path):
    import json

    from sedimenta.sources.framing import read_v1_journal

    good = {"at": "2026-01-01T00:00:00Z", "event": "ingest", "cas_id": "sha256:" + "0" * 64, "size": 1, "media_type": "t", "source_root_id": "s", "original_relpath": "a", "mtime": "m", "batch": None, "outcome": "stored"}
    lines = [good, good | {"mtime": ""}, good | {"schema": "journal.v2"}, {k: v for k, v in good.items() if k != "batch"}, good | {"size": True}, good | {"original_relpath": "../x"}]
    (tmp_path / "v1.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    records, errors = read_v1_journal(spark, str(tmp_path / "v1.jsonl"))
    assert {r["ord"]: r["errors"] for r in errors.collect()} == {2: "mtime", 3: "already-migrated", 4: "keys", 5: "size", 6: "relpath"}
    line = '{"at":"2026-01-01T00:00:00Z","batch":null,"cas_id":"sha256:%s","event":"ingest","media_type":"t","mtime":"m","original_relpath":"a","outcome":"stored","size":1,"source_root_id":"s"}' % ("0" * 64)
    import hashlib

    migrated = composites.migrate_v1(records.filter("ord = 1")).first()
    assert migrated["event_id"] == f"v1:{1:016d}:sha256:{hashlib.sha256(line.encode()).hexdigest()}" and migrated["schema"] == "journal.v2"


def test_ingest_of_a_folder(spark, tmp_path):
    from sedimenta.sources.framing import ingest

    for name, content in (("top.txt", "same"), ("nested/one.txt", "same"), ("nested/deep/two.dat", "other"), ("known.txt", "known")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    import hashlib

    stored = spark.createDataFrame([("sha256:" + hashlib.sha256(b"known").hexdigest(),)], "cas_id string")
    journal, objects, refused = ingest(spark, str(tmp_path / "in"), "root", stored, "2026-01-01T00:00:00Z", "b1")
    rows = journal.orderBy("at").collect()
    assert [(r["original_relpath"], r["outcome"]) for r in rows] == [("known.txt", "dedup"), ("nested/deep/two.dat", "stored"), ("nested/one.txt", "stored"), ("top.txt", "dedup")]
    assert [r["at"] for r in rows] == [f"2026-01-01T00:00:00.{i:06d}Z" for i in range(1, 5)] and objects.count() == 2 and refused.isEmpty()
    numbered = journal.withColumn("ord", F.monotonically_increasing_id())
    assert validate.record_errors(numbered).isEmpty()
    single = ingest(spark, str(tmp_path / "in" / "top.txt"), "root", stored, "2026-01-01T00:00:00Z")[0].collect()
    assert [(r["original_relpath"], r["outcome"]) for r in single] == [("top.txt", "stored")]


def test_requests_and_lifecycle(spark):
    from sedimenta.operators import operations

    request = {"operation_id": "1", "kind": "excise", "args": {"entry_ids": ["b", "a"]}}
    same = {"operation_id": "2", "kind": "excise", "args": {"entry_ids": ["a", "b"]}}
    assert operations.fingerprint(request, "s") == operations.fingerprint(same, "s") != operations.fingerprint(same | {"kind": "x"}, "s")
    with pytest.raises(tree.Refusal, match="repeated"):
        operations.normalised({"args": {"entry_ids": ["a", "a"]}})
    assert [operations.lifecycle(m) for m in ({}, {"state": "retired"}, {"state": "x"}, {"state": "active"}, {"state": "active", "store_id": "s"})] == ["invalid", "retired", "not-active", "identity-required", None]
    identity = dict(store_id="a", lineage_id="l", epoch_id="e", generation=1, predecessor_epoch_id=None)
    assert excise.successor(identity, "b", "f") == dict(store_id="b", lineage_id="l", epoch_id="f", generation=2, predecessor_epoch_id="e")
    ids = spark.createDataFrame([("x",)], "id string")
    assert operations.in_any(ids, spark.createDataFrame([("y",), ("x",)], "id string")) and not operations.in_any(ids, spark.createDataFrame([("y",)], "id string"))


def test_traces_finalise_once(spark):
    from sedimenta.operators import traces

    ledger = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 20, 7)], "trace_id bigint, span_id bigint, en bigint")
    again = spark.createDataFrame([(1, 11, 6), (1, 10, 5), (3, 30, 8)], "trace_id bigint, span_id bigint, en bigint")
    assert [r["trace_id"] for r in traces.finalised(ledger, again).collect()] == [3]
    for odd in ([(1, 10, 5)], [(1, 10, 5), (1, 11, 7)]):
        with pytest.raises(traces.Conflict):
            traces.finalised(ledger, spark.createDataFrame(odd, ledger.schema))
    open_ = spark.createDataFrame([(1, None, "run", 0, None, None), (2, 1, "gate", 5, None, None), (3, 1, "gate", 1, 2, "success")], "span_id bigint, parent_span_id bigint, category string, st bigint, en bigint, outcome string")
    assert {(r["span_id"], r["en"], r["outcome"]) for r in traces.recovered(open_, 9).collect()} == {(1, 9, "interrupted"), (2, 9, "interrupted"), (3, 2, "success")}
    with pytest.raises(traces.Conflict):
        traces.recovered(open_.filter("span_id > 1"), 9)


def test_manifests_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "PART_BYTES", 200)
    n = 100_050  # more than the published format allows
    df = spark.range(n, numPartitions=5).selectExpr("concat('e', id) AS entry_id", "'file' AS kind", "'/' AS parent_id", "concat('\u00e4,', id) AS name", "id AS size", "id AS changed_revision", "1 AS live")
    text = snapshots.header("n1", "plain", 5, "/", {"generation": 1})
    members, row, parts = snapshots.capture(df, "s1", 5, text)
    lines = [canonical_bytes(f'{{"metadata":{{}},"entry_id":"e{i}","kind":"file","parent_id":"/","name":"\u00e4,{i}","cas_id":null,"size":{i},"changed_revision":{i}}}').decode().rstrip() for i in sorted(range(n), key=str)]
    whole = (text[0] + ",".join(lines) + text[1]).encode()
    assert [(r["cas_id"], r["size"]) for r in row.collect()] == [("sha256:" + hashlib.sha256(whole).hexdigest(), len(whole))]
    assert [tuple(r) for r in snapshots.over_limits(parts).collect()] == [("s1", n, len(whole))]
    assert snapshots.over_limits(parts, n, len(whole)).isEmpty()
    found, errors = snapshots.decode(parts)
    assert errors.isEmpty() and found.count() == n and found.exceptAll(members.select(found.columns)).isEmpty()


def test_torn_manifests_are_errors(spark):
    text = snapshots.header("n1", "plain", 5, "/", {"generation": 1})
    entry = '{"cas_id":null,"changed_revision":1,"entry_id":"a","kind":"file","metadata":{},"name":"x","parent_id":"/","size":1}'
    manifests = {
        "good": (text[0], entry, text[1]), "keys": (text[0].replace("cas_binding", "binding"), entry, text[1]), "entries": (text[0], entry[:-1], text[1]), "two": (text[0], entry + "," + entry, text[1]),
        "open": (text[0], entry, text[1][:2]), "null": (text[0].replace("[", "null"), entry, text[1].replace("]", "")),
    }
    rows = [("no ends", 1, 1, entry)] + [(k, number, int(number == 1), t) for k, parts in manifests.items() for number, t in zip((0, 1, snapshots.LAST), parts, strict=True)]
    members, errors = snapshots.decode(spark.createDataFrame(rows, "snapshot_id string, number bigint, n bigint, text string"))
    assert {r["snapshot_id"] for r in members.collect()} == {"good"}
    assert {r["snapshot_id"]: r["error"] for r in errors.collect()} == {"keys": "keys", "entries": "entries", "two": "entries", "open": "keys", "null": "entries", "no ends": "keys"}


def test_declared_conflicts_group_only_dealt_rows(spark, monkeypatch):
    from sedimenta.operators import operations

    monkeypatch.setattr(operations, "ROWS", 2)
    df = spark.createDataFrame([("o1", "a", 1), ("o1", "a", 2), ("o1", "a", 2), ("o1", "b", 1), ("o2", "a", 1), ("o2", "b", None), ("o2", "b", 3), (None, "c", 1), (None, "c", 4)], "operation_id string, cas_id string, size int")
    found = operations.declared_conflicts(df)
    assert {tuple(r) for r in found.collect()} == {("o1", "a", 2), (None, "c", 2)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange") :] and ", 5)" in plan[plan.index("Exchange") :]  # 9 rows, 2 a part
