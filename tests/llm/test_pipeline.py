import os

import pytest

import corpus_pipeline
from foralia.runtime import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    docs = table(spark, SF, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
            assert out.where("n_chars <> char_length(text)").count() == 0
        counts.append(out.count())
        if name in ("quality_rules", "near_dedup"):
            assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        docs = out
    assert counts[0] < 200 and counts[1] == counts[0] and counts[2] <= counts[1]
    assert docs.selectExpr("max(offset + length)").first()[0] <= 2048


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
