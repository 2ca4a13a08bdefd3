"""Registered queries beside their SQL, and the pipeline's stages beside the operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from millwatch.llm.oracles import LLM_SQL
from millwatch.llm.queries import llm_queries
from millwatch.session import stage
from tests.compare import difference, duck


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in llm_queries())
    assert numbers == list(range(1, 14))
    assert set(entry.queries()) >= {*llm_queries(), "pipeline"} and set(LLM_SQL) < set(llm_queries())


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(llm_queries()[name](spark, sf).toPandas(), duck(sf).execute(LLM_SQL[name]).df()) is None


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs, seen = stage(docs.unionByName(extra), "pipeline-test"), {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, sf), f"test-{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
    n = {name: df.count() for name, df in seen.items()}
    assert n["language_id"] == n["line_dedup"] == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < n["simhash_dedup"] <= n["line_dedup"] and n["mixing"] == n["sentencepiece"] > 0
    assert seen["line_dedup"].where("n_chars <> length(text)").isEmpty()
    assert seen["simhash_dedup"].join(seen["line_dedup"].withColumnRenamed("text", "t"), "doc_id").where("text <> t").isEmpty()
    assert seen["sentencepiece"].where("not round_trip or size(ids) <> n_ids").isEmpty()
