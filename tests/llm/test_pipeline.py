"""Columns of every name pass through the pipeline's stages unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import empty, messy

CLASHES = ["doc", "c1", "c2", "_c1", "_copy", "copy", "size", "taken", "times", "n_words", "n_removed", "ids", "row_", "whole", "kept", "clean_text", "k0", "label", "group", "a.b", "n-m"]


@pytest.mark.parametrize("rows", ["messy", "empty"])
def test_clashing_columns_come_out_as_they_went_in(spark, tmp_path, rows):
    docs = (messy(spark) if rows == "messy" else empty(spark)).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({f"{c}": F.concat_ws("|", F.lit(c), F.col("doc_id").cast("string"), F.col("lang")) for c in CLASHES})
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns, name
        for c in CLASHES:
            assert docs.where(~F.col(f"`{c}`").eqNullSafe(F.concat_ws("|", F.lit(c), F.col("doc_id").cast("string"), F.col("lang")))).count() == 0, (name, c)
    assert (docs.count() > 0) == (rows == "messy")
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == (rows == "messy")
