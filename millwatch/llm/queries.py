"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.llm.centroids import cluster_vectors
from millwatch.llm.chat_format import format_chats
from millwatch.llm.common import table
from millwatch.llm.embedding_dedup import near_vectors
from millwatch.llm.html_extract import extract
from millwatch.llm.language_id import identify
from millwatch.llm.line_dedup import dedup_lines
from millwatch.llm.mixing import copy_counts
from millwatch.llm.sentencepiece_codec import encode
from millwatch.llm.simhash import simhash_groups
from millwatch.llm.substring_dedup import dedup_substrings
from millwatch.llm.topk import top_k
from millwatch.llm.toxicity import score_toxicity
from millwatch.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_ids", "ids", "round_trip")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("text")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 100 = 0"), rows, 10)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = copy_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def llm_queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_line_dedup, op2_sentencepiece, op3_embedding_dedup, op4_language_id, op5_substring_dedup, op6_top_k, op7_chat_format, op8_html_extraction, op9_mixing, op10_simhash, op11_whitening, op12_centroids, op13_toxicity)}
