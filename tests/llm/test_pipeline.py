"""The pipeline stage by stage against plain Python, and on odd rows."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import ODD_ROWS
from tests.llm.test_dedup import brute_groups, brute_substrings
from tests.llm.test_tokens import check_packing

STAGES = dict(corpus_pipeline.STAGES)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_in_order():
    assert list(STAGES) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_every_stage(spark, sf_dir, documents):
    kept = STAGES["language_id"](spark, documents, sf_dir)
    assert kept.columns == documents.columns and kept.count() == documents.count()  # all are clean prose
    single = STAGES["near_dedup"](spark, documents, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({g[2] for g in brute_groups(pairs(documents))})
    cut = STAGES["substring_dedup"](spark, documents, sf_dir)
    want = {r[0]: r[1] - r[2] for r in brute_substrings(pairs(documents))}
    assert {r["doc_id"]: len((r["text"] or "").split()) for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    clean = {d for d, _ in pairs(STAGES["decontamination"](spark, documents, sf_dir))}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not clean & {d for d, t in pairs(documents) if any(i in t for i in items)}
    assert len(clean) > 0.9 * documents.count()


def test_run_is_the_stages_one_after_another(spark, sf_dir, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = set(docs.columns), stage(spark, docs, sf_dir)
        assert set(docs.columns) == before, name
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), pairs(docs))


def test_stages_take_odd_and_no_rows(spark, sf_dir, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert 0 < out.count() <= len(ODD_ROWS) + 100 and stage(spark, empty, sf_dir).count() == 0
        assert name == "packing" or out.columns == odd.columns
