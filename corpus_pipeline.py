"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.llm.common import carried, prepare, stage, table
from millwatch.llm.language_id import drop_unidentified
from millwatch.llm.line_dedup import dedup_lines
from millwatch.llm.mixing import mixed
from millwatch.llm.sentencepiece_codec import encode
from millwatch.llm.simhash import drop_near_copies


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in which no language is found go; ``lang`` becomes the prediction."""
    prepare(spark)
    return drop_unidentified(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go; ``n_chars``, where there is one, follows the text."""
    prepare(spark)
    packed, columns = carried(docs, keys=("doc_id", "text"))
    done = dedup_lines(packed).select(*columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    prepare(spark)
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row as often as the target weights of its source ask."""
    prepare(spark)
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: each row with its ids, and whether they decode to its text again."""
    prepare(spark)
    return encode(docs, check=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("simhash_dedup", unique_documents),
    ("mixing", mix),
    ("sentencepiece", encoded),
]

#: Language ID and SimHash cannot be stated in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
