"""Embedding whitening: float32 eigenvectors of an exact covariance, corrected in higher precision."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.blocks import beside, floored, of_one_length, product
from millwatch.llm.common import shuffle_partitions, stage
from millwatch.llm.vectors import finite, matrix

SCALE, SHIFT = 64, 1_000_000
#: Scaled components stay below this, so that they fit 32 bits.
LIMIT = 1 << 30
#: Eigenvalues below this share of the largest, times the dimensions, count as zero: no direction can be told from rounding.
NOTHING = 2.0**-50
MOST_STEPS, MOST_DEPTH = 20, 8
HIGH = np.longdouble


def _runs(values: np.ndarray, gap: float) -> np.ndarray:
    """Cluster number of each value; values that follow each other within ``gap`` share one."""
    order = np.argsort(values, kind="stable")
    number = np.concatenate([[0], np.cumsum(np.diff(values[order]) > gap)])
    out = np.empty(len(values), int)
    out[order] = number
    return out


def eigen(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to more than double precision.

    The vectors X start from a float32 solver. An iteration of Ogita and Aishima takes R = I - X'X and S = X'AX in extended
    precision and adds X E, where E solves the first-order equations for the error: (S + lambda_j R) / (lambda_j - lambda_i),
    and R / 2 where two eigenvalues are closer than the residual lets one tell. Such clusters are solved apart: the matrix X_J' A X_J less
    its mean eigenvalue is small, so a solver scaled to it resolves gaps that the whole matrix hides, again by float32 and corrections.
    A cluster whose matrix is rounding only is a multiple eigenvalue, for which any basis serves.
    """
    d = len(a)
    eps = np.finfo(HIGH).eps
    scale = np.abs(a).max() if d else HIGH(0)
    if d < 2 or scale == 0:
        return np.diag(a).astype(HIGH), np.eye(d, dtype=HIGH)
    b = a.astype(HIGH) / scale
    x = np.linalg.eigh(b.astype(np.float32))[1].astype(HIGH)
    one = np.eye(d, dtype=HIGH)
    tolerance = 8 * d * eps
    for _ in range(MOST_STEPS):
        r = one - x.T @ x
        s = x.T @ (b @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = np.abs(s - np.diag(np.diag(s))).max()
        if off <= tolerance and np.abs(r).max() <= tolerance:
            break
        delta = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(b.astype(float)) * np.linalg.norm(r.astype(float)))
        of = _runs(values, delta)
        same = of[:, None] == of[None, :]
        gap = np.where(same, HIGH(1), values[None, :] - values[:, None])
        x = x + x @ np.where(same, r / 2, (s + values[None, :] * r) / gap)
        for number in np.flatnonzero(np.bincount(of) > 1) if depth < MOST_DEPTH else ():
            j = np.flatnonzero(of == number)
            part = x[:, j].T @ (b @ x[:, j])
            part = (part + part.T) / 2
            part = part - np.trace(part) / len(j) * np.eye(len(j), dtype=HIGH)
            if np.abs(part).max() > tolerance:
                x[:, j] = x[:, j] @ eigen(part, depth + 1)[1]
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(64 c) of each vector as 32-bit integers."""
    for batch in batches:
        for dims, some in of_one_length(batch, "v"):
            y = floored(matrix(some.column("v"), float), SCALE, LIMIT).astype("<i4")
            data = pa.array([row.tobytes() for row in y], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array([dims] * len(some), pa.int32()), data], ["vec_id", "dims", "y"])


def _packed(salts: int):
    """Rows of one length as blocks ``(dims, salt, ids, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                data = b"".join(some.column("y").to_pylist())
                number += 1
                ids = some.column("vec_id").to_pylist() if "vec_id" in some.schema.names else None
                columns = [pa.array([int(d)], pa.int32()), pa.array([number % salts], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["dims", "salt", "ids", "data"])

    return run


def _block(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], "<i4").reshape(-1, row["dims"]).astype(np.int64)


def _texts(sums: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Per length, a count and a table of integers of any size."""
    columns = [pa.array([*sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([json.dumps(t.tolist()) for _, t in sums.values()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["dims", "n", "total"])


def _added(rows: list[dict]) -> tuple[int, np.ndarray]:
    """The counts and tables of several tasks, added."""
    total = sum(np.array(json.loads(r["total"]), dtype=object) for r in rows)
    return sum(r["n"] for r in rows), total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            y = _block(row)
            n, total = held.get(row["dims"], (0, 0))
            held[row["dims"]] = n + len(y), total + y.sum(axis=0).astype(object)
    yield _texts(held)


def _centre(table: pa.Table) -> pa.Table:
    """Count, rounded mean ``m`` and rest ``r = S - n m`` of each dimension."""
    n, total = _added(table.to_pylist())
    m = np.array([s // n for s in total], "<i8")
    r = np.array([s % n for s in total], "<i8")
    return pa.table({"dims": pa.array([table.column("dims")[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([m.tobytes()]), "r": pa.array([r.tobytes()])})


CENTRE = "dims int, n long, m binary, r binary"


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of products of the centred integers, a table per length and task."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            y = _block(row) - np.frombuffer(row["m"], "<i8")
            n, total = held.get(row["dims"], (0, 0))
            held[row["dims"]] = n + len(y), total + product(y.T, y).astype(object)
    yield _texts(held)


def _solved(most: int):
    """The whitening of one length: covariance, eigenvectors, and each one over the root of its eigenvalue."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        n, total = _added(rows)
        r = np.frombuffer(rows[0]["r"], "<i8").astype(object)
        # The covariance of y - r / n, as one fraction: exact until the last division.
        exact = n * total - np.outer(r, r)
        v = np.array([[HIGH(str(c)) for c in line] for line in exact.tolist()]).reshape(len(r), -1) / (HIGH(str(n)) * HIGH(str(n)))
        values, vectors = eigen(v)
        values, vectors = values[:most], vectors[:, :most]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0) < 0, -1, 1)
        trace = np.trace(v)
        some = values > len(r) * NOTHING * max(values.max(), 0)
        root = np.where(some, np.sqrt(np.where(some, values, 1)), np.nan)
        share = np.where(some, values / trace if trace > 0 else np.nan, 0.0 if trace > 0 else np.nan)
        return pa.table({
            "dims": pa.array([len(r)], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([rows[0]["m"]]), "r": pa.array([rows[0]["r"]]),
            "w": pa.array([(vectors / root).astype("<f8").tobytes()]), "explained": pa.array([share.astype("<f8").tobytes()]),
        })

    return run


MODEL = f"{CENTRE}, w binary, explained binary"


def _whitened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers of a block, and their whitened components."""
    y = _block(row) - np.frombuffer(row["m"], "<i8")
    r = np.frombuffer(row["r"], "<i8")
    return y, (y - r / row["n"]) @ np.frombuffer(row["w"], "<f8").reshape(row["dims"], -1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened components and of their products, per length and task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            z = _whitened(row)[1]
            held[row["dims"]] = held.get(row["dims"], 0) + np.vstack([z.sum(axis=0)[None, :], z.T @ z])
    columns = [pa.array([*held], pa.int32()), pa.array([t.tobytes() for t in held.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["dims", "total"])


def _checked(table: pa.Table) -> pa.Table:
    """The largest entry of the whitened covariance minus the identity, beside the model."""
    rows = table.to_pylist()
    c = np.frombuffer(rows[0]["explained"], "<f8").size
    total = sum(np.frombuffer(r["total"], "<f8").reshape(c + 1, c) for r in rows) / rows[0]["n"]
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(c))
    worst = float(np.nanmax(error)) if np.isfinite(error).any() else None
    kept = {name: pa.array([rows[0][name]], kind) for name, kind in (("dims", pa.int32()), ("n", pa.int64()), *((b, pa.binary()) for b in ("m", "r", "w", "explained")))}
    return pa.table({**kept, "identity_error": pa.array([worst], pa.float64())})


def _deviation(y: np.ndarray, n: int, r: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; null beyond 63 bits."""
    if y.shape[1] * (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 < 1 << 62:
        return ((n * y - r) ** 2).sum(axis=1).tolist()
    exact = ((n * y.astype(object) - r.astype(object)) ** 2).sum(axis=1).tolist()
    return [e if e < 1 << 63 else None for e in exact]


RESULT = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            y, z = _whitened(row)
            count, c = z.shape
            share = np.tile(np.frombuffer(row["explained"], "<f8"), count)
            ids = pa.array(row["ids"], pa.int64()).take(pa.array(np.repeat(np.arange(count), c)))
            far = pa.array(_deviation(y, row["n"], np.frombuffer(row["r"], "<i8")), pa.int64()).take(pa.array(np.repeat(np.arange(count), c)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), count)), pa.array(np.full(count * c, row["n"])), far,
                pa.array(z.ravel(), from_pandas=True), pa.array(share, from_pandas=True), pa.array([row["identity_error"]] * (count * c), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, list(RESULT))


def whiten(df: DataFrame, components: int = 16) -> DataFrame:
    """Whitened components of the vectors of ``df(vec_id, embedding)``: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold null or non-finite components are left out. A component c becomes x = floor(64 c) + 1,000,000.
    The fit list is each distinct vector once: ``n`` of them, with sums S. Eigenvectors of its covariance (divisor n) are numbered from 1 by
    falling eigenvalue e; the largest entry of each is positive. ``whitened`` is (x - S / n) projected on one, over the root of e; ``explained`` is e over the
    trace; ``deviation`` the exact sum of (n x - S)^2; ``identity_error`` the largest entry of the whitened covariance minus the identity, measured over the fit list.

    Distinct vectors are found by a plain aggregation, which reduces repeated vectors inside the tasks first. Sums, and then products of the integers less
    their rounded mean, are exact integers, one table of d x d per task; they are added in a task that also solves the d x d problem (``eigen``). Blocks of
    vectors meet the model by (length, salt), so it does not matter that all share one length. Nothing goes to the driver.

    Vectors of another length are a fit list of their own; empty ones have no components and so no rows. Repeated rows, and rows with a null vec_id, are all returned. A
    component without variance (constant vectors, fewer vectors than dimensions) has a null ``whitened``, explained 0 (null where the trace is 0) and takes
    no part in ``identity_error``, which is null if there is no other. A deviation beyond 63 bits is null. Components of 2^24 or more are an error. An empty table gives
    an empty result; other columns are ignored.
    """
    salts = shuffle_partitions(df.sparkSession)
    good = df.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = good.mapInArrow(_scaled, "vec_id long, dims int, y binary")
    blocked = "dims int, salt int, ids array<long>, data binary"
    fit = stage(rows.select("dims", "y").distinct().mapInArrow(_packed(salts), blocked).drop("ids"), "whitening-fit")
    added = "dims int, n long, total string"
    centre = stage(fit.mapInArrow(_sums, added).groupBy("dims").applyInArrow(_centre, CENTRE), "whitening-centre")
    totals = beside(fit, centre, "dims", salts).select("dims", "data", "m").mapInArrow(_products, added)
    solved = totals.join(centre.select("dims", "m", "r"), "dims").groupBy("dims").applyInArrow(_solved(components), MODEL)
    model = stage(solved, "whitening-model")
    totals = beside(fit, model, "dims", salts).drop("salt").mapInArrow(_spread, "dims int, total binary")
    checked = totals.join(model, "dims").groupBy("dims").applyInArrow(_checked, f"{MODEL}, identity_error double")
    model = stage(checked, "whitening-checked")
    blocks = beside(rows.mapInArrow(_packed(salts), blocked), model, "dims", salts).drop("salt")
    return blocks.mapInArrow(_applied, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
