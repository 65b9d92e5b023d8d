"""Queries with SQL against it, and the pipeline's stages against brute force."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op10_chat_format"])
def test_query_matches_its_sql(spark, name):
    from sedimenta.llm.queries import ORACLES, QUERIES

    same(QUERIES[name](spark, SF), connection(SF), ORACLES[name])


def test_every_operator_has_a_query():
    from sedimenta.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    import corpus_pipeline
    from sedimenta.llm.common import persisted, remainder, table
    from sedimenta.llm.toxicity import fit
    from tests.llm.test_methods import brute_components

    docs = table(spark, SF, "documents")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(persisted(stage(spark, outs[-1], SF), name))
    assert [c.columns == docs.columns for c in outs[1:5]] == [True] * 4
    texts = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outs[:4]]
    model = fit(docs, table(spark, SF, "labels"), remainder(F.col("doc_id"), 5) != 0)
    score = model.scorer()
    assert set(texts[1]) == {d for d, t in texts[0].items() if score(t.encode()) < 0.5}
    keep = {}
    for d, t in texts[1].items():
        k = t.encode().lower()
        keep[k] = max(d, keep.get(k, d))
    assert set(texts[2]) == set(keep.values())
    assert set(texts[3]) == {d for d, (_, c) in brute_components(texts[2].items()).items() if c == d}
    assert {r["doc_id"] for r in outs[4].collect()} <= set(texts[3])
    pieces = outs[5].collect()
    copies = {}
    for r in outs[4].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    firsts = {}
    for r in pieces:
        if r["piece"] == 0:
            firsts[r["doc_id"]] = firsts.get(r["doc_id"], 0) + 1
    assert firsts == copies


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_pipeline_stages_on_odd_rows(spark, monkeypatch, broadcast):
    """Ids that repeat with other texts, rows without id, nulls, repeated rows, an empty table, columns of the stages' own names."""
    import corpus_pipeline
    from sedimenta.llm import parity_join

    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(parity_join, "BROADCAST_ROWS", broadcast)
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "A same"), (5, "B unique text"), (7, "A same"), (7, "A same"), (None, "alone"), (None, "alone"), (None, "a SAME"), (1, None), (2, ""), (8, long), (8, long + " more"), (9, long + " end"), (9, "other"), (None, "last")]
    extra = {c: F.lit("x") for c in ("stays", "__id", "__text", "__key", "__score", "component_id", "kept", "uid", "copies")}
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(extra)
    key = lambda df: sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, docs, SF)
    expected = [(False, 5, "B unique text"), (False, 7, "A same"), (True, None, "alone"), (False, 2, ""), (False, 8, long), (False, 8, long + " more"), (False, 9, long + " end"), (False, 9, "other"), (True, None, "last")]
    assert key(once) == sorted(expected, key=str) and once.columns == docs.columns
    near = stages["near_dedup"](spark, once, SF)
    left = [r for r in key(near) if r[2].startswith("w0")]
    assert len(left) == 1 and left[0][1] == 8 and near.columns == docs.columns
    assert [r for r in key(near) if not r[2].startswith("w0")] == sorted((e for e in expected if not e[2].startswith("w0")), key=str)
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    mix = stages["mixing"](spark, near, SF)
    assert mix.columns == docs.columns
    assert stages["packing"](spark, mix, SF).count() == mix.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
