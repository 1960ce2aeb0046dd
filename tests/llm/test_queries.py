"""Registered queries of the preparation operators on the driver's tables, and the pipeline against a plain version."""

from __future__ import annotations

import re

import pytest

from corvane.llm import queries
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="the driver's tables are not here")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, queries.queries()[name], SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 11))


def test_scores_cover_every_document(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("op1_toxicity", "op4_quality", "op6_language_id"):
        got = queries.queries()[name](spark, sf)
        assert got.count() == docs.count() and got.join(docs, "doc_id", "left_anti").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from corvane.llm import common, mixing
    from tests.llm.test_dedup_decontam import brute_decontaminate, brute_groups
    from tests.llm.test_tables import brute_mix

    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "mixing"]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name == "mixing":
            assert set(names) < set(out.columns)
            want = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.SCHEDULE)
            have = {(r.doc_id, r.epoch): r.position for r in out.collect()}
            assert set(have) == set(want) and all(have[k] == pytest.approx(want[k], abs=1e-3) for k in want)
            break
        assert out.columns == names
        kept, _ = common.stage(out, "test")
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "near_dedup":
            groups, _ = brute_groups(before)
            assert set(after) == {i for i, _ in before if groups.get(i, i) == i}
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert after == brute_decontaminate(before, items)
        else:
            assert set(after.items()) <= set(before) and len(after) > len(before) / 2
        docs = kept
    whole = {(r.doc_id, r.epoch, r.position) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r.doc_id, r.epoch, r.position) for r in out.collect()}


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null and repeated ids, very long texts, columns named like the ones that mixing adds."""
    import corpus_pipeline
    from corvane.llm import common

    sf = str(DATA / "sf0.001")
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = [(None, "a text without an id that is long enough to be read by anyone who cares", "en", "src1", 70), (7001, None, "en", "src1", 0), (7002, "", None, None, 0), (7003, long, "en", None, len(long)),
           (7004, "one and the same row stands here twice for a test of repeated rows", "en", "src2", 66), (7004, "one and the same row stands here twice for a test of repeated rows", "en", "src2", 66)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'e' AS epoch", "'p' AS POSITION", "1 AS n_tokens", "2 AS drop__", "3 AS evidence", "4 AS toxic")
    docs, _ = common.stage(docs, "edges")
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for where in (sf, str(tmp_path)):  # with labels and a benchmark, and with empty ones
        current = docs
        for name, step in corpus_pipeline.STAGES:
            out, _ = common.stage(step(spark, current, where), "edge")
            assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing") == (len(out.columns) > len(docs.columns))
            current = out
            ids = [r.doc_id for r in current.collect()]
            if name == "near_dedup":
                assert ids.count(7004) <= 1 and ids.count(None) <= 1
            if name == "decontamination" and where != sf:  # nothing rejects them
                assert {7001, 7002, 7003, 7004, None} <= set(ids)
        # texts without tokens have no place, nor has the only text of the null source: its middle is beyond the source's demand
        assert not {7001, 7002, 7003} & set(ids) and (where == sf or {7004, None} <= set(ids))
        assert out.columns[-3:] == ["n_tokens_", "epoch_", "position_"]
    empty = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))  # takes nothing from under the first
    assert empty.count() == 0 and again.count() == 0 and "position" in empty.columns
