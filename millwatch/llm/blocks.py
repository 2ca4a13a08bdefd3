"""Vectors packed in blocks of one length, and small tables laid beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.vectors import matrix

#: The most vectors in one block.
ROWS = 4096


def floored(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as integers below ``limit`` in size; larger components are an error, as sums would overflow."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() >= limit:
        raise ValueError(f"a component of {np.abs(x).max()} is too large: {scale} times it must stay below {limit}")
    return y.astype(np.int64)


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """Integers in the fewest bytes that hold them all, and the size of one."""
    most = int(np.abs(x).max()) if x.size else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
    return x.astype(f"<i{size}").tobytes(), size


def widen(data: bytes, size: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(-1, columns).astype(np.int64)


def of_one_length(batch: pa.RecordBatch, column: str, rows: int = ROWS) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their list ``column``, at most ``rows`` at once; empty lists are left out."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    for length in np.unique(lengths[lengths > 0]):
        which = np.flatnonzero(lengths == length)
        for at in range(0, len(which), rows):
            yield int(length), batch.take(pa.array(which[at : at + rows]))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of integer matrices: through doubles where they hold every sum, else through 64-bit or Python's integers."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b if most < 1 << 62 else a.astype(object) @ b.astype(object)


def beside(blocks: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """``blocks`` with the row of ``small`` that has the same ``key``.

    All blocks may share one key, so they carry a ``salt`` below ``salts`` and ``small`` is repeated for each: should
    Spark shuffle the blocks, they fall in as many groups. ``small`` has a row per key and nothing that grows with the blocks.
    """
    return blocks.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"])


__all__ = ["ROWS", "beside", "floored", "matrix", "narrow", "of_one_length", "product", "widen"]
