"""The registered queries and the pipeline on a small table."""

import pytest

import corpus_pipeline
from fieldspark.llm import registered
from fieldspark.llm.common import written

from ..oracle import connect, rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_oracle(spark, name):
    assert rows_of(registered.QUERIES[name](spark, SF)) == sql_rows(connect(SF), registered.ORACLES[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= before and len(kept) > 0.5 * len(before), name
        before = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == before


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
    assert docs.count() == 0


def test_pipeline_with_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"row": registered.F.lit(1), "score": registered.F.lit("x"), "spans": registered.F.lit(2)})
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
    assert docs.count() > 100
