"""The pipeline's stages: contracts between them, edge cases, and each decision's effect."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge(spark):
    long = "the river of stone and the garden of paper was in the window by night " * 400
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "the and of that was for it with the", "en", "s", 5), (3, "the and of that was for it with the", "en", "s", 5), (None, "de la que el en los por con", "es", "s", 7), (4, long, "en", "s", 9), (5, long + " x", "en", "s", 9), (6, "de la que el en los por con para del", "es", None, 3)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("letter", "score", "lang_pred", "_language", "_gone", "_text", "_doc", "id", "kept")})


def test_stages(spark):
    assert len(corpus_pipeline.STAGES) == 5
    for docs in (edge(spark), edge(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 0 < len(ids) < docs.count()
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_act_on_all_that_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        total.append(docs.count())
    assert total == sorted(total, reverse=True) and total[1] < total[0] and total[3] < total[2] and total[4] < total[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.count() > 0.95 * docs.where(F.col("text").rlike(r"\p{L}")).count()


@pytest.mark.parametrize("k", range(4))
def test_repeated_rows(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    once = corpus_pipeline.STAGES[k][1](spark, docs, SF).select("doc_id").distinct().count()
    twice = corpus_pipeline.STAGES[k][1](spark, docs.union(docs), SF)
    assert twice.select("doc_id").distinct().count() == once and twice.count() == 2 * once
