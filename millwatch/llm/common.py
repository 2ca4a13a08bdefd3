"""Helpers shared by the operators: staging, Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millwatch.session import configure, stage

__all__ = ["binaries", "carried", "components", "named", "partitions_for", "prepare", "stage", "table"]

#: The most bytes of rows Spark hands to Python at once; long texts make smaller batches, not larger ones.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session options the Arrow operators need; safe to call again."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return F.col(f"`{column.replace('`', '``')}`")


def carried(docs: DataFrame, new: Iterable[str] = (), keys: tuple[str, ...] = ("text",)) -> tuple[DataFrame, list[Column]]:
    """``docs`` as ``(__row, *keys)``, and the columns that restore it less those named, in any case, like ``new``."""
    gone = {n.lower() for n in new}
    names = [c for c in docs.columns if c.lower() not in gone]
    others = [c for c in names if c not in keys]
    # Fields get plain names on the way, so that any name comes back as it was.
    row = F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(others))) if others else F.struct(F.lit(0).alias("c0"))
    back = {c: F.col(f"__row.c{i}").alias(c) for i, c in enumerate(others)}
    return docs.select(row.alias("__row"), *keys), [back[c] if c in back else F.col(c) for c in names]


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()


def partitions_for(amount: float, each: float, least: int) -> int:
    """Partitions so that each holds about ``each`` of ``amount``."""
    return max(least, ceil(amount / each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numpy_batches(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """The named integer columns of all batches, joined."""
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for part, name in zip(parts, names):
            part.append(batch.column(name).to_numpy(zero_copy_only=False))
    return [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]


def hash_sample(df: DataFrame, about: int, *keys: str) -> DataFrame:
    """About ``about`` rows of ``df``, the same ones every time, chosen by the hash of ``keys``; all of a small table.

    Sampling before ordering keeps what the tasks send to the driver in proportion to the sample, not to their number.
    """
    share = min(1.0, about / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars around the smallest node, which
    takes a logarithmic number of rounds. Every round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Only a row count and a checksum reach the driver.
    Each node's minimum is written before it is joined back: both sides of that join are then plain
    exchanges, which Spark splits where one node has very many links. Nulls and self-links are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(edges.where("a > b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a > b").distinct(), "large-star")
        lowest = stage(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = stage(lowest.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "small-star")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
