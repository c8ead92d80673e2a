"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

import pytest

import corpus_pipeline
from lectern.llm import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    right, note = compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert right, note


def test_pipeline(spark, con):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [before.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.where("text rlike '[^ \\\\n]'").select("doc_id").distinct().count()
