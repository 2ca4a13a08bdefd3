"""Centroid clustering: Lloyd's rounds with vectors and centroids cut into blocks of dimensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.blocks import ROWS, beside, floored, narrow, product, widen
from millwatch.llm.common import shuffle_partitions, stage
from millwatch.llm.vectors import finite, matrix

SCALE = 64
#: Dimensions in one block of columns.
WIDTH = 16
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _limit(dims: int) -> int:
    """Components stay below this, so that no squared distance leaves 62 bits."""
    return 1 << ((60 - dims.bit_length()) // 2)


def _batch(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, names.values())], list(names))


BLOCK = {"part": pa.int64(), "shard": pa.int32(), "salt": pa.int32(), "width": pa.int32(), "ids": pa.list_(pa.int64()), "data": pa.binary(), "size": pa.int32()}
BLOCK_DDL = "part long, shard int, salt int, width int, ids array<long>, data binary, size int"


def _cut(dims: int, width: int, salts: int):
    """Vectors to blocks: up to ``ROWS`` vectors make a part, ``width`` of their dimensions a shard of it. Ids go with the first shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = floored(matrix(batch.column("v"), float).reshape(-1, dims), SCALE, _limit(dims))
            for at in range(0, len(x), ROWS):
                rows = []
                for shard, low in enumerate(range(0, dims, width)):
                    some = x[at : at + ROWS, low : low + width]
                    ids = batch.column("vec_id").slice(at, ROWS).to_pylist() if shard == 0 else None
                    rows.append((part, shard, part % salts, some.shape[1], ids, *narrow(some)))
                yield _batch(BLOCK, rows)
                part += 1

    return run


PARTIAL = {"part": pa.int64(), "data": pa.binary(), "size": pa.int32()}


def _partial(k: int):
    """Exact squared distances of a part to every centroid over the shards at hand; adjoining shards of a part are added here already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                x, c = widen(row["data"], row["size"], row["width"]), np.frombuffer(row["slice"], np.int64).reshape(k, row["width"])
                d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * product(x, c.T)
                if held == row["part"]:
                    total = total + d
                    continue
                if held is not None:
                    yield _batch(PARTIAL, [(held, *narrow(total))])
                held, total = row["part"], d
        if held is not None:
            yield _batch(PARTIAL, [(held, *narrow(total))])

    return run


def _nearest(k: int):
    """All shards of one part: distances added, the smallest taken, the smaller number at a tie."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(widen(row["data"], row["size"], k) for row in table.to_pylist())
        best = total.argmin(axis=1)
        least = total[np.arange(len(total)), best]
        row = (table.column("part")[0].as_py(), best.astype("<i4").tobytes(), least.astype("<i8").tobytes())
        return pa.Table.from_batches([_batch({"part": pa.int64(), "cluster": pa.binary(), "distance": pa.binary()}, [row])])

    return run


SUM = {"shard": pa.int32(), "sums": pa.binary(), "counts": pa.binary()}


def _summed(k: int):
    """Sums and counts of each cluster over a task's blocks, one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, cluster = widen(row["data"], row["size"], row["width"]), np.frombuffer(row["cluster"], "<i4")
                sums, counts = held.setdefault(row["shard"], (np.zeros((k, row["width"]), np.int64), np.zeros(k, np.int64)))
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        yield _batch(SUM, [(s, sums.tobytes(), counts.tobytes()) for s, (sums, counts) in held.items()])

    return run


def _moved(k: int):
    """The slice of one shard after a round: floor(sum / count), and the old components where a cluster has no vector."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        old = np.frombuffer(rows[0]["slice"], np.int64).reshape(k, -1)
        sums = sum(np.frombuffer(r["sums"], np.int64).reshape(old.shape) for r in rows)
        counts = sum(np.frombuffer(r["counts"], np.int64) for r in rows)[:, None]
        new = np.where(counts > 0, sums // np.maximum(counts, 1), old)
        return pa.Table.from_batches([_batch({"shard": pa.int32(), "slice": pa.binary()}, [(rows[0]["shard"], new.tobytes())])])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["ids", "cluster", "distance"]).to_pylist():
            columns = [pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["cluster"], "<i4")), pa.array(np.frombuffer(row["distance"], "<i8"))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: str = "1:", width: int = WIDTH) -> DataFrame:
    """Clusters of the vectors of ``df(vec_id, embedding)`` after ``rounds`` rounds of Lloyd's algorithm, in exact integers.

    Vectors that do not have exactly ``dims`` components, or hold null or non-finite ones, are left out. A component x becomes
    floor(64 * x). The first centroids are the ``k`` vectors with the smallest sha256 of ``seed`` and the vec_id, in that
    order. Each round gives every vector to the nearest centroid (the smaller number at a tie), then moves every centroid that
    has vectors to the floor of their mean. Returned: ``vec_id, cluster, distance`` (squared), ``cluster_inertia, inertia`` (sums of
    distances) and ``centroid_sha256`` of the final centroid's components joined by commas.

    Tasks hold blocks of up to 4,096 vectors and ``width`` dimensions beside the same slice of the centroids and compute exact
    partial distances. Adding them by part gives each vector's nearest centroid. Its number goes back to the
    blocks, whose sums move each slice by itself, so no task needs a whole centroid. Nothing is keyed by cluster: the
    size of a cluster does not matter. A round moves a part's distances and its narrowed integers once. Per task one
    row per shard is summed; to the driver go ``k`` seeds, and ``k`` sums and centroids at the end. Every round is written to the shared folder.

    Fewer than ``k`` vectors make fewer clusters, an empty table an empty result. Rows with a null vec_id are clustered, and become seeds only
    where others do not suffice. Repeated rows all count, and are seeds as often as they occur; those with one vec_id are ordered by
    their components. Other columns are ignored. Components so large that a distance could leave 62 bits are an error.
    """
    spark = df.sparkSession
    salts = shuffle_partitions(spark)
    kept = df.where(finite("embedding") & (F.size("embedding") == dims))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = kept.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT)
    k = len(seeds)
    first = floored(np.array([r["v"] for r in seeds], float).reshape(k, dims), SCALE, _limit(dims))
    slices = [(shard, first[:, low : low + width].tobytes()) for shard, low in enumerate(range(0, dims, width))]
    slices = spark.createDataFrame(slices, "shard int, slice binary")
    blocks = stage(kept.mapInArrow(_cut(dims, width, salts), BLOCK_DDL), "centroid-blocks")
    vectors = blocks.select("part", "shard", "salt", "width", "data", "size")

    def nearest(slices: DataFrame) -> DataFrame:
        partial = beside(vectors, slices, "shard", salts).select("part", "data", "size", "width", "slice")
        partial = partial.mapInArrow(_partial(k), "part long, data binary, size int")
        return partial.groupBy("part").applyInArrow(_nearest(k), "part long, cluster binary, distance binary")

    for number in range(rounds):
        given = vectors.join(nearest(slices).select("part", "cluster"), "part").select("shard", "width", "data", "size", "cluster")
        sums = given.mapInArrow(_summed(k), "shard int, sums binary, counts binary").join(slices, "shard")
        slices = stage(sums.groupBy("shard").applyInArrow(_moved(k), "shard int, slice binary"), f"centroids-{number}")
    given = blocks.where("shard = 0").select("part", "ids").join(nearest(slices), "part").select("ids", "cluster", "distance")
    given = stage(given.mapInArrow(_rows, "vec_id long, cluster int, distance long"), "clusters")
    inertia = dict(given.groupBy("cluster").agg(F.sum("distance")).collect())
    final = np.hstack([np.frombuffer(r["slice"], np.int64).reshape(k, -1) for r in sorted(slices.collect())])
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    at = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")[F.col("cluster")]
    return given.select(
        "vec_id",
        "cluster",
        "distance",
        at([inertia.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        at(named, "string").alias("centroid_sha256"),
    )
