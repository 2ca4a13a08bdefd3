"""A forecaster that sees the whole window: each tag from all tags at each of the ``window_size`` snapshots before.

Continuous tags are forecast by least squares, binary tags by a logistic model. Snapshots are packed once into blocks, one
per equipment and bucket of snapshot numbers, with the rows that windows reach back and ahead to; every pass reads these blocks beside a
model, so a window is never written out and no task holds more than one bucket of rows. What a pass sums leaves a task as
one row per cell of the equation system; only the system of one model is solved in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.operators.buckets import BUCKET, BUCKET_TICKS, add_halo, spread
from millwatch.session import stage

VERSION = ["equipment_id", "model_version"]
KEY_SCHEMA = "equipment_id string, model_version bigint"
#: Weight of the squared coefficients beside the mean log loss; it keeps the logits of separable and constant tags finite.
RIDGE = 1e-8
#: A logit is fitted once no mean gradient exceeds this.
GRADIENT = 1e-12
MOST_ROUNDS = 60
#: Sums of curvature that a task holds before it passes them on, in cells.
HELD_CELLS = 8_000_000
WINDOWS_AT_ONCE = 1024


def z_values(name: str) -> Column:
    """Normalised values of a row joined to ``norm_mean`` and ``norm_std``."""
    return F.transform(name, lambda v, i: (v - F.get("norm_mean", i)) / F.get("norm_std", i))


# --- blocks of snapshots -------------------------------------------------------------------

BLOCK_SCHEMA = f"equipment_id string, {BUCKET} bigint, versions array<bigint>, width int, tags int, seq binary, tick binary, data binary, version binary, own binary"


def _packed(size: int):
    def run(table: pa.Table) -> pa.Table:
        # Not every Spark type keeps its order through the shuffle, so rows are put in order here.
        table = table.sort_by("seq")
        seq = table.column("seq").to_numpy().astype("<i8")
        values = table.column("values").combine_chunks()
        data = values.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        bucket = table.column(BUCKET)[0].as_py()
        own = seq // size == bucket
        # Minus one: no target, only history for other rows.
        target = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
        version = np.where(target, table.column("model_version").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False), -1).astype("<i8")
        found = np.unique(version[version >= 0]).tolist()
        row = [
            table.column("equipment_id")[0].as_py(), bucket, found, table.column("window_size")[0].as_py(), len(data) // len(seq),
            seq.tobytes(), table.column("tick").to_numpy().astype("<i8").tobytes(), data.tobytes(), version.tobytes(), own.astype("u1").tobytes(),
        ]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        names = ["equipment_id", BUCKET, "versions", "width", "tags", "seq", "tick", "data", "version", "own"]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return run


def pack_windows(rows: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Blocks of ``rows(equipment_id, seq, tick, values, window_size, model_version, target)``, staged.

    A target is a row that ends a full window and is fitted to, or forecast by, the model of its version (0 or more); the other rows are there
    because windows reach back to them. Buckets count snapshots, and a block has the ``window_size`` rows on either side of its bucket too.
    """
    rows = rows.select("equipment_id", "seq", "tick", "values", F.col("window_size").cast("int").alias("window_size"), F.col("model_version").cast("long").alias("model_version"), "target")
    halo = add_halo(rows, "seq", size, back=F.col("window_size"), ahead=F.col("window_size"))
    packed = spread(halo, ["equipment_id"]).groupBy("equipment_id", BUCKET).applyInArrow(_packed(size), BLOCK_SCHEMA)
    return stage(packed.filter(F.size("versions") > 0), "window-blocks")


def beside_models(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Blocks with each model their targets ask for. Models are repeated per block they meet, so a join never gathers the blocks of a machine."""
    asked = blocks.select("equipment_id", F.explode("versions").alias("model_version"), BUCKET)
    placed = models.join(asked, VERSION)
    return blocks.withColumn("model_version", F.explode("versions")).drop("versions").join(placed, [*VERSION, BUCKET])


class _Block:
    """A block's normalised rows laid out by snapshot number; rows that are missing or incomplete count as zero and are never looked at."""

    def __init__(self, row: dict):
        seq = np.frombuffer(row["seq"], "<i8")
        at = seq - seq[0]
        self.width, self.tags = row["width"], row["tags"]
        z = (np.frombuffer(row["data"], "<f8").reshape(len(seq), -1) - np.array(row["norm_mean"], float)) / np.array(row["norm_std"], float)
        self.z = np.zeros((int(at[-1]) + 1, self.tags))
        self.z[at] = np.where(np.isfinite(z), z, 0.0)
        self.target = np.zeros(len(self.z), bool)
        self.target[at] = np.frombuffer(row["version"], "<i8") == row["model_version"]
        self.own = np.zeros(len(self.z), bool)
        self.own[at] = np.frombuffer(row["own"], "u1") > 0
        self.tick = np.zeros(len(self.z), np.int64)
        self.tick[at] = np.frombuffer(row["tick"], "<i8")

    def targets(self) -> np.ndarray:
        return np.flatnonzero(self.target & self.own)

    def seen(self, at: np.ndarray) -> np.ndarray:
        """One row per target: a one, then all tags one snapshot back, two back, and so on."""
        return np.hstack([np.ones((len(at), 1)), *(self.z[at - lag] for lag in range(1, self.width + 1))])

    def forecast(self, at: np.ndarray, coef: np.ndarray) -> np.ndarray:
        out = np.tile(coef[:, 0], (len(at), 1))
        for lag in range(1, self.width + 1):
            out += self.z[at - lag] @ coef[:, 1 + (lag - 1) * self.tags : 1 + lag * self.tags].T
        return out


def _out(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, names.values())], list(names))


# --- least squares -----------------------------------------------------------------------

_SUMS = {"equipment_id": pa.string(), "model_version": pa.int64(), "tags": pa.int32(), "width": pa.int32(), "sums": pa.list_(pa.float64())}


def _lag_products(block: _Block) -> np.ndarray:
    """Sums of z(t-i) z(t-j)' over the targets t, for every pair of lags, in a compact form.

    Seen from s = t-i the product is z(s) z(s-d)' with d = j-i: it does not depend on i as long as all of s, s+1, ..., s+W are targets. So there is one
    matrix per d for such rows (block Toeplitz), and one per i and d only for rows near a gap, if there are any. A leading one in z gives sums and the count.
    """
    w, d = block.width, block.tags + 1
    z = np.hstack([np.ones((len(block.z), 1)), block.z])
    ahead = np.zeros((w + 1, len(z)), bool)
    for i in range(min(w + 1, len(z))):
        ahead[i, : len(z) - i] = block.target[i:]
    ahead &= block.own
    whole = np.flatnonzero(ahead.all(axis=0))
    regular = np.stack([z[whole].T @ z[whole - lag] for lag in range(w + 1)]) if len(whole) else np.zeros((w + 1, d, d))
    edge = ahead.any(axis=0) & ~ahead.all(axis=0)
    if not edge.any():
        return regular.ravel()
    extra = np.zeros((w + 1, w + 1, d, d))
    for i in range(w + 1):
        s = np.flatnonzero(ahead[i] & edge)
        for lag in range(w + 1 - i) if len(s) else ():
            extra[i, lag] = z[s].T @ z[s - lag]
    return np.concatenate([regular.ravel(), extra.ravel()])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            yield _out(_SUMS, [(row["equipment_id"], row["model_version"], block.tags, block.width, _lag_products(block))])


def normal_equations(sums: np.ndarray, tags: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y from the sums of ``_lag_products``."""
    d = tags + 1
    regular = sums[: (width + 1) * d * d].reshape(width + 1, d, d)
    extra = np.zeros((width + 1, width + 1, d, d))
    if len(sums) > regular.size:
        extra = sums[regular.size :].reshape(extra.shape)
    pair = lambda i, j: regular[j - i] + extra[i, j - i] if i <= j else pair(j, i).T
    size = 1 + width * tags
    xx, xy = np.zeros((size, size)), np.zeros((size, tags))
    now = pair(0, 0)
    xx[0, 0], xy[0] = now[0, 0], now[0, 1:]
    for i in range(1, width + 1):
        at = slice(1 + (i - 1) * tags, 1 + i * tags)
        xx[0, at] = xx[at, 0] = pair(i, i)[0, 1:]
        xy[at] = pair(i, 0)[1:, 1:]
        for j in range(1, width + 1):
            xx[at, 1 + (j - 1) * tags : 1 + j * tags] = pair(i, j)[1:, 1:]
    return xx, xy


def solve_normal(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Offset and weights, one column per tag, of least squares; the least-norm solution where columns depend on each other."""
    n = xx[0, 0]
    mean, level = xx[0, 1:] / n, xy[0] / n
    c, r = xx[1:, 1:] - n * np.outer(mean, mean), xy[1:] - n * np.outer(mean, level)
    size = np.sqrt(np.maximum(np.diag(c), 0))
    size = np.where(size > 1e-7 * np.sqrt(n), size, np.inf)
    c, r = c / np.outer(size, size), r / size[:, None]
    live = np.isfinite(size)
    part = c[np.ix_(live, live)]
    try:
        root = np.linalg.cholesky(part)
        good = not len(root) or np.diag(root).min() > 1e-5
    except np.linalg.LinAlgError:
        good = False
    found = np.linalg.solve(root.T, np.linalg.solve(root, r[live])) if good else np.linalg.lstsq(part, r[live], rcond=1e-10)[0]
    weights = np.zeros_like(r)
    weights[live] = found / size[live, None]
    return np.vstack([level - mean @ weights, weights])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for tags, width, places, totals in zip(batch["tags"], batch["width"], batch["places"], batch["totals"]):
            d = tags + 1
            sums = np.zeros((width + 1) * d * d * (1 if len(places) <= (width + 1) * d * d else width + 2))
            sums[np.asarray(places, int)] = totals
            xx, xy = normal_equations(sums, tags, width)
            found.append((int(round(xx[0, 0])), solve_normal(xx, xy).T.tolist()))
        yield batch[VERSION].assign(n_windows=[n for n, _ in found], coef=[c for _, c in found])


def _gathered(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of partial sums, added cell by cell: ``places`` and ``totals`` per key. Tasks add their own rows before the shuffle."""
    return (
        sums.select(*keys, F.posexplode("sums").alias("place", "part"))
        .groupBy(*keys, "place")
        .agg(F.sum("part").alias("total"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("place", "total")).alias("cells"))
        .select(*keys, F.col("cells.place").alias("places"), F.col("cells.total").alias("totals"))
    )


def fit_linear(blocks: DataFrame, normalisation: DataFrame) -> DataFrame:
    """``(equipment_id, model_version, n_windows, coef)``: per tag an offset and one weight per lag and tag, lag by lag, by least squares."""
    pairs = beside_models(blocks, normalisation.select(*VERSION, "norm_mean", "norm_std"))
    sums = pairs.mapInArrow(_products, f"{KEY_SCHEMA}, tags int, width int, sums array<double>")
    return _gathered(sums, [*VERSION, "tags", "width"]).mapInPandas(_solve, f"{KEY_SCHEMA}, n_windows bigint, coef array<array<double>>")


# --- logistic models ------------------------------------------------------------------------

_CURVE = {"equipment_id": pa.string(), "model_version": pa.int64(), "pos": pa.int32(), "sums": pa.list_(pa.float64())}
_COEF = {"equipment_id": pa.string(), "model_version": pa.int64(), "n_windows": pa.int64(), "coef": pa.list_(pa.list_(pa.float64()))}
COEF_SCHEMA = f"{KEY_SCHEMA}, n_windows bigint, coef array<array<double>>"
LOGIT_SCHEMA = f"{KEY_SCHEMA}, pos int, beta array<double>, best array<double>, best_loss double, done boolean"


def _curve(block: _Block, targets: np.ndarray, pos: int, beta: np.ndarray) -> np.ndarray:
    """Count, log loss, gradient and curvature of the tag at ``pos`` over some targets of a block; no coefficients yet means zeros."""
    x, y = block.seen(targets), block.z[targets, pos]
    line = x @ (beta if len(beta) else np.zeros(x.shape[1]))
    p = 1 / (1 + np.exp(-np.clip(line, -700, 700)))
    loss = (np.logaddexp(0, line) - y * line).sum()
    return np.concatenate([[len(targets), loss], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def _curvature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, log loss, gradient and curvature at the current coefficients of each open tag, added up over a task's blocks."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, sums) for key, sums in held.items()]
        held.clear()
        return _out(_CURVE, rows)

    for batch in batches:
        for row in batch.to_pylist():
            block, targets = _Block(row), None
            targets = block.targets()
            for at in range(0, len(targets), WINDOWS_AT_ONCE):
                some = targets[at : at + WINDOWS_AT_ONCE]
                for tag in row["open"]:
                    sums = _curve(block, some, tag["pos"], np.array(tag["beta"], float))
                    key = (row["equipment_id"], row["model_version"], tag["pos"])
                    held[key] = held[key] + sums if key in held else sums
            if sum(map(len, held.values())) > HELD_CELLS:
                yield flush()
    yield flush()


def _newton_step(sums: np.ndarray, now: np.ndarray, was: np.ndarray, was_loss: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """The next coefficients, the best ones, their loss, and is that all: back half-way where the loss rose, else a Newton step."""
    n = sums[0]
    size = int(round((-1 + np.sqrt(1 + 4 * (len(sums) - 2))) / 2))
    now = now if len(now) else np.zeros(size)
    value = sums[1] / n + RIDGE / 2 * (now @ now)
    gradient = sums[2 : 2 + size] / n + RIDGE * now
    if np.isfinite(was_loss) and value > was_loss + 1e-13 * abs(was_loss):
        return (now + was) / 2, was, was_loss, bool(np.abs(now - was).max() < 1e-12)
    curve = sums[2 + size :].reshape(size, size) / n + RIDGE * np.eye(size)
    return now - np.linalg.solve(curve, gradient), now, value, bool(np.abs(gradient).max() <= GRADIENT)


def _newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One step of each open tag; done where the gradient has vanished."""
    for batch in batches:
        beta, best, loss, done = [], [], [], []
        for now, was, was_loss, places, totals in zip(batch["beta"], batch["best"], batch["best_loss"], batch["places"], batch["totals"]):
            sums = np.zeros(len(places))
            sums[np.asarray(places, int)] = totals
            after, found, value, ended = _newton_step(sums, np.asarray(now, float), np.asarray(was, float), was_loss)
            beta.append(after.tolist())
            best.append(found.tolist())
            loss.append(value)
            done.append(ended)
        yield batch[[*VERSION, "pos"]].assign(beta=beta, best=best, best_loss=loss, done=done)


def fit_logits(blocks: DataFrame, normalisation: DataFrame) -> DataFrame:
    """``(equipment_id, model_version, pos, beta)`` of every binary tag: iteratively reweighted least squares on the log loss.

    Each round is one aggregation for all machines: gradient and curvature of every tag that is still open. Tags whose gradient has vanished leave
    the table, so later rounds read the blocks of fewer machines. A tiny ridge gives tags that can be separated, or never change
    among the targets, finite coefficients. Rounds are staged; only the number of open tags reaches the driver.
    """
    keys = [*VERSION, "pos"]
    scale = normalisation.select(*VERSION, "norm_mean", "norm_std")
    kinds = normalisation.select(*VERSION, F.posexplode("tag_type").alias("pos", "kind")).filter("kind = 'binary'")
    none = F.array().cast("array<double>")
    start = kinds.select(*keys, none.alias("beta"), none.alias("best"), F.lit(None).cast("double").alias("best_loss"), F.lit(False).alias("done"))
    targets = blocks.select("equipment_id", F.explode("versions").alias("model_version")).distinct()
    state = stage(start.join(targets, VERSION), "logits")
    ended = []
    for number in range(MOST_ROUNDS):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        per_model = open_.groupBy(*VERSION).agg(F.sort_array(F.collect_list(F.struct("pos", "beta"))).alias("open"))
        pairs = beside_models(blocks, per_model.join(scale, VERSION))
        sums = _gathered(pairs.mapInArrow(_curvature, f"{KEY_SCHEMA}, pos int, sums array<double>"), keys)
        ended.append(state.filter("done"))
        state = stage(open_.join(sums, keys).mapInPandas(_newton, LOGIT_SCHEMA), f"logits-{number}")
    found = state
    for part in ended:
        found = found.unionByName(part)
    return found.select(*keys, F.col("best").alias("beta"))


def _fit_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines and logits of models whose targets all lie in one block: the sums of that block are the whole sums, so all rounds stay here."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            block = _Block(row)
            targets = block.targets()
            xx, xy = normal_equations(_lag_products(block), block.tags, block.width)
            coef = solve_normal(xx, xy).T
            for pos, kind in enumerate(row["tag_type"]):
                if kind != "binary":
                    continue
                now, best, loss = np.array([]), np.array([]), np.nan
                for _ in range(MOST_ROUNDS):
                    parts = (_curve(block, targets[at : at + WINDOWS_AT_ONCE], pos, now) for at in range(0, len(targets), WINDOWS_AT_ONCE))
                    now, best, loss, done = _newton_step(sum(parts), now, best, loss)
                    if done:
                        break
                coef[pos] = best
            found.append((row["equipment_id"], row["model_version"], int(round(xx[0, 0])), coef.tolist()))
        yield _out(_COEF, found)


def fit_windows(training: DataFrame, normalisation: DataFrame, size: int = BUCKET_TICKS) -> tuple[DataFrame, DataFrame]:
    """The coefficients ``(equipment_id, model_version, n_windows, coef)`` and the blocks they were fitted on.

    ``training`` needs ``seq``, ``tick``, ``values``, ``window_size`` and ``fit``; ``normalisation`` is one row per model with ``tag_type``, ``norm_mean`` and
    ``norm_std``. Weights of a binary tag are those of its logit. A model that one block holds is fitted where that block is read; sums are
    exchanged for the others only.
    """
    blocks = pack_windows(training.withColumn("target", F.col("fit")), size)
    held = blocks.select("equipment_id", F.explode("versions").alias("model_version")).groupBy(*VERSION).agg(F.count(F.lit(1)).alias("blocks"))
    held = stage(held, "model-blocks")
    single = normalisation.join(held.filter("blocks = 1"), VERSION, "left_semi").select(*VERSION, "tag_type", "norm_mean", "norm_std")
    alone = beside_models(blocks, single).mapInArrow(_fit_alone, COEF_SCHEMA)
    if held.filter("blocks > 1").isEmpty():
        return alone, blocks
    normalisation = normalisation.join(held.filter("blocks > 1"), VERSION, "left_semi")
    lines = fit_linear(blocks, normalisation)
    logits = fit_logits(blocks, normalisation).groupBy(*VERSION).agg(F.collect_list(F.struct("pos", "beta")).alias("logits"))
    own = lambda i: F.get(F.filter("logits", lambda x: x["pos"] == i), F.lit(0))["beta"]
    merged = F.transform("coef", lambda line, i: F.coalesce(own(i), line))
    lines = lines.join(logits, VERSION, "left").withColumn("coef", F.when(F.col("logits").isNull(), F.col("coef")).otherwise(merged)).drop("logits")
    return lines.unionByName(alone), blocks


# --- forecasts ----------------------------------------------------------------------------

_ERRORS = {"equipment_id": pa.string(), "model_version": pa.int64(), "tick": pa.int64(), "errors": pa.list_(pa.float64())}


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            at = block.targets()
            if not len(at):
                continue
            forecast = block.forecast(at, np.array(row["coef"], float))
            binary = np.array([kind == "binary" for kind in row["tag_type"]])
            forecast[:, binary] = 1 / (1 + np.exp(-np.clip(forecast[:, binary], -700, 700)))
            errors = np.abs(block.z[at] - forecast)
            lists = pa.ListArray.from_arrays(np.arange(0, errors.size + 1, block.tags, dtype=np.int32), errors.ravel())
            columns = [pa.array([row["equipment_id"]] * len(at)), pa.array([row["model_version"]] * len(at), pa.int64()), pa.array(block.tick[at]), lists]
            yield pa.RecordBatch.from_arrays(columns, list(_ERRORS))


def window_errors(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """``(equipment_id, model_version, tick, errors)`` of the targets of ``blocks`` under ``models`` with ``coef``."""
    columns = [*VERSION, "tag_type", "norm_mean", "norm_std", "coef"]
    return beside_models(blocks, models.select(*columns)).mapInArrow(_errors, f"{KEY_SCHEMA}, tick bigint, errors array<double>")
