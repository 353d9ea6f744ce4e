"""The pipeline's stages, each on its own input, on a small corpus."""

import os

import pytest

import corpus_pipeline
from pagespark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = corpus_pipeline.kept(stage(spark, docs, SMALL))
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.6 * len(before)
        if name != "best_fit_packing":
            assert out.schema == docs.schema
            docs = out
        else:
            assert after == before
    assert spark.read.parquet(f"{SMALL}/labels.parquet").count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_every_operator_has_a_query():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
