"""Failure risk in the next hour: boosted trees on the minute features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators.inspection import FEATURES, class_weight
from millwatch.session import stage

# Rounds at most, idle rounds after which boosting ends, tree depth and leaves, rows per leaf, step and the alarm limit.
ROUNDS = 1000
PATIENCE = 40
MAX_DEPTH = 5
MAX_LEAVES = 31
MIN_LEAF_ROWS = 20
STEP = 0.03
ALARM_PROBABILITY = 0.60

#: Bins of a feature, and the ranks (one of so many) to which the cuts that divide the search for their limits are exact.
BINS = 64
ROUGH_ACCURACY = 1_000
#: Trees between two writes of the running margins.
SLICE = 8
#: Classes that one task of a pass reads.
CLASSES_PER_TASK = 500_000
#: Bins of the score histogram that an AUC is read from.
SCORE_BINS = 1 << 14
NODES = 1 << (MAX_DEPTH + 1)
NODE_SCHEMA = "tree int, node int, feature string, cut double, n_rows long, value double"


@dataclass(frozen=True)
class Tree:
    """Nodes by number: the root is 1, node k has 2k (not above the cut) and 2k + 1. ``feature`` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    n_rows: np.ndarray
    value: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(MAX_DEPTH):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + (x[row, f] > self.cut[node]), node)
        return self.value[node]


def margins(trees: tuple[Tree, ...], x: np.ndarray, start: np.ndarray | float = 0.0) -> np.ndarray:
    """``start`` plus the values of ``trees``, added one after the other."""
    total = np.zeros(len(x)) + start
    for tree in trees:
        total = total + tree.values(x)
    return total


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


@dataclass(frozen=True)
class RiskModel:
    """``trees`` up to the best round; ``grown`` also holds the idle rounds after it."""

    trees: tuple[Tree, ...]
    report_auc: float
    scale_pos_weight: float
    grown: tuple[Tree, ...] = ()

    def first(self, n: int) -> RiskModel:
        """The model as it was after ``n`` rounds."""
        return replace(self, trees=self.grown[:n])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node; ``feature`` and ``cut`` are null at leaves."""
        rows = [
            (t, k, FEATURES[f] if f >= 0 else None, float(tree.cut[k]) if f >= 0 else None, int(tree.n_rows[k]), float(tree.value[k]))
            for t, tree in enumerate(self.trees)
            for k, f in enumerate(tree.feature.tolist())
            if tree.n_rows[k] > 0
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        about = F.lit(self.report_auc).alias("report_auc"), F.lit(self.scale_pos_weight).alias("scale_pos_weight")
        self.nodes(spark).select("*", *about).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        rows = spark.read.parquet(path).orderBy("tree", "node").toPandas()
        trees = []
        for _, nodes in rows.groupby("tree"):
            tree, at = _empty_tree(), nodes["node"].to_numpy()
            tree.feature[at] = [FEATURES.index(f) if isinstance(f, str) else -1 for f in nodes["feature"]]
            tree.cut[at] = nodes["cut"].fillna(0.0)
            tree.n_rows[at], tree.value[at] = nodes["n_rows"], nodes["value"]
            trees.append(tree)
        one = rows.iloc[0] if len(rows) else {"report_auc": 0.5, "scale_pos_weight": 1.0}
        return RiskModel(tuple(trees), float(one["report_auc"]), float(one["scale_pos_weight"]), tuple(trees))


def _empty_tree() -> Tree:
    return Tree(np.full(NODES, -1), np.zeros(NODES), np.zeros(NODES, np.int64), np.zeros(NODES))


def bin_limits(rows: DataFrame) -> list[list[float]]:
    """For each feature the distinct values at ranks 1/64 to 63/64, by which its bins are cut; exact at any size.

    Rough cuts only divide the work: equal values are counted, running counts are taken between two rough cuts, and what lies below is
    added from a total per division. The values at the ranks then follow whatever the rough cuts are.
    """
    ranks = F.lit([k / BINS for k in range(1, BINS)])
    rough = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), ranks, ROUGH_ACCURACY).alias(f) for f in FEATURES)).first()
    rough = [sorted(set(rough[f] or ())) for f in FEATURES]
    cells = rows.select(F.posexplode(F.array(*(F.col(f).cast("double") for f in FEATURES))).alias("f", "x")).where("x is not null")
    part = F.coalesce(*(F.when(F.col("f") == f, _cuts_below(F.col("x"), cuts)) for f, cuts in enumerate(rough)))
    counts = stage(cells.groupBy("f", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part), "value-counts")
    totals = {(r["f"], r["part"]): r["n"] for r in counts.groupBy("f", "part").agg(F.sum("n").alias("n")).collect()}
    wanted = []
    for f in range(len(FEATURES)):
        parts = sorted(p for g, p in totals if g == f)
        ends = np.cumsum([totals[f, p] for p in parts])
        for rank in sorted({max(1, -(-int(ends[-1]) * k // BINS)) for k in range(1, BINS)}) if parts else ():
            at = int(np.searchsorted(ends, rank))
            wanted.append((f, parts[at], int(rank - (ends[at - 1] if at else 0))))
    upto = F.sum("n").over(W.partitionBy("f", "part").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    places = rows.sparkSession.createDataFrame(wanted, "f int, part int, place long").groupBy("f", "part").agg(F.collect_list("place").alias("places"))
    hit = F.exists("places", lambda place: (place > F.col("upto") - F.col("n")) & (place <= F.col("upto")))
    found = counts.withColumn("upto", upto).join(places, ["f", "part"]).where(hit).select("f", "x").collect()
    return [sorted(r["x"] for r in found if r["f"] == f) for f in range(len(FEATURES))]


def binned_classes(rows: DataFrame, limits: list[list[float]]) -> DataFrame:
    """``(bins, target, role, n, margin)``: rows that boosting cannot tell apart, counted.

    Trees see bins only, so equal bins have equal margins in every round. Most minutes of a line are alike: the table is far
    shorter than the rows, and every pass after this one reads it alone.
    """
    low = F.lit(float("-inf"))
    values = [F.coalesce(F.nanvl(F.col(f).cast("double"), low), low).alias(f) for f in FEATURES]
    names = [f"b{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.searchsorted(cuts, batch.column(f).to_numpy()).astype(np.int32) for f, cuts in zip(FEATURES, limits)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, bins), batch.column("target"), batch.column("role")], [*names, "target", "role"])

    binned = rows.select(*values, F.col("target").cast("int").alias("target"), "role")
    binned = binned.mapInArrow(run, ", ".join(f"{b} int" for b in names) + ", target int, role string")
    counted = binned.groupBy(*names, "target", "role").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("margin", F.lit(0.0))


def _cuts_below(x: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda v: v < x)) if cuts else F.lit(0)


def _split(batch: pa.RecordBatch, trees: tuple[Tree, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, targets, counts and margins after ``trees``."""
    x = np.column_stack([batch.column(f"b{i}").to_numpy() for i in range(len(FEATURES))])
    y, n = batch.column("target").to_numpy(), batch.column("n").to_numpy()
    return x, y, n, margins(trees, x, batch.column("margin").to_numpy())


def _level_sums(trees: tuple[Tree, ...], growing: Tree, weight: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of slope, curvature and rows per open node, feature and bin of a task's classes."""
    place = replace(growing, value=np.arange(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = NODES * len(FEATURES) * BINS
        sums = np.zeros((3, cells))
        for batch in batches:
            x, y, n, margin = _split(batch, trees)
            p = np.clip(probability(margin), 1e-9, 1 - 1e-9)
            w = np.where(y == 1, weight, 1.0) * n
            node = place.values(x)
            for f in range(len(FEATURES)):
                at = (node * len(FEATURES) + f) * BINS + x[:, f]
                for total, what in zip(sums, (w * (y - p), w * p * (1 - p), n)):
                    total += np.bincount(at, what, cells)
        some = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], ["cell", "slope", "bend", "n"])

    return run


def _leaf(sums: np.ndarray, step: float) -> float:
    """A Newton step; none where all rows weigh nothing, as positives do when there is no negative."""
    return float(step * sums[0] / sums[1]) if sums[1] > 0 else 0.0


def _grown(classes: DataFrame, trees: tuple[Tree, ...], weight: float, step: float) -> Tree:
    """The next tree, level by level: one aggregation each, of at most 32 nodes x features x bins rows.

    A split must leave 20 rows on both sides and gain something; gains equal to six digits go to the first feature and the lowest cut.
    """
    tree, gains = _empty_tree(), np.zeros(NODES)
    for level in range(MAX_DEPTH):
        sums = classes.mapInArrow(_level_sums(trees, tree, weight), "cell long, slope double, bend double, n double")
        found = sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("slope", "bend", "n"))).toArrow()
        table = np.zeros((3, NODES * len(FEATURES) * BINS))
        table[:, found["cell"].to_numpy()] = [found[c].to_numpy() for c in ("slope", "bend", "n")]
        upto = table.reshape(3, NODES, len(FEATURES), BINS).cumsum(axis=3)
        whole = upto[:, :, :1, -1:]
        if level == 0:
            tree.n_rows[1], tree.value[1] = whole[2, 1, 0, 0], _leaf(whole[:, 1, 0, 0], step)
        for node in range(1 << level, 2 << level):
            if not whole[2, node, 0, 0]:
                continue
            slope, bend, _ = whole[:, node, 0, 0]
            left, right = upto[:, node], whole[:, node] - upto[:, node]
            fair = (left[2] >= MIN_LEAF_ROWS) & (right[2] >= MIN_LEAF_ROWS)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fair, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - slope**2 / bend, 0.0)
            gain = np.nan_to_num(gain, nan=0.0, posinf=0.0, neginf=0.0).round(6)
            best = int(gain.argmax())
            if gain.flat[best] > 0:
                f, cut = divmod(best, BINS)
                tree.feature[node], tree.cut[node], gains[node] = f, cut, gain.flat[best]
                for child, side in ((2 * node, left), (2 * node + 1, right)):
                    tree.n_rows[child], tree.value[child] = side[2, f, cut], _leaf(side[:, f, cut], step)
        if not (tree.feature[1 << level : 2 << level] >= 0).any():
            break
    _limit_leaves(tree, gains)
    return tree


def _limit_leaves(tree: Tree, gains: np.ndarray) -> None:
    """Undo the least useful last splits while there are more than 31 leaves."""
    while (splits := np.flatnonzero(tree.feature >= 0)).size >= MAX_LEAVES:
        last = [k for k in splits.tolist() if 2 * k >= NODES // 2 or (tree.feature[[2 * k, 2 * k + 1]] < 0).all()]
        least = min(last, key=lambda k: (gains[k], k))
        tree.feature[least], tree.cut[least] = -1, 0.0
        tree.n_rows[[2 * least, 2 * least + 1]] = 0
        tree.value[[2 * least, 2 * least + 1]] = 0.0


def area(scores: np.ndarray, positives: np.ndarray, negatives: np.ndarray) -> float:
    """AUC of counted scores, ties counting half; a half where a class is missing."""
    order = np.argsort(scores)
    up, down = positives[order], negatives[order]
    pairs = float(up.sum()) * float(down.sum())
    return float((up * (down.cumsum() - down / 2)).sum() / pairs) if pairs else 0.5


def round_areas(classes: DataFrame, trees: tuple[Tree, ...]) -> list[float]:
    """AUC after each of ``trees``, all from one pass: a score histogram per round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, margin = _split(batch, ())
            for k, tree in enumerate(trees):
                margin = margin + tree.values(x)
                at = np.minimum((probability(margin) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
                bins, place = np.unique(at, return_inverse=True)
                counts = [np.bincount(place, n * (y == side), len(bins)) for side in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k)), pa.array(bins), *map(pa.array, counts)], ["k", "bin", "pos", "neg"])

    found = classes.mapInArrow(run, "k long, bin long, pos double, neg double").groupBy("k", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    groups = dict(list(found.groupby("k")))
    return [area(*(groups[k][c].to_numpy() for c in ("bin", "pos", "neg"))) if k in groups else 0.5 for k in range(len(trees))]


def best_round(areas: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds up to the highest AUC before ``patience`` rounds pass without a higher one, and whether they did pass."""
    best = 0
    for k, auc in enumerate(areas):
        if auc > areas[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return min(best + 1, len(areas)), False


def boosted(classes: DataFrame, weight: float, rounds: int, step: float, slice_rounds: int = SLICE) -> tuple[tuple[Tree, ...], int]:
    """All trees grown on role ``fit`` and the number up to the best round on role ``stop``.

    Boosting goes on from the margins of its classes, a column that is written again after every ``slice_rounds`` trees; no round is
    fitted twice. Trees are the same whatever the slice.
    """
    grown: tuple[Tree, ...] = ()
    areas: list[float] = []
    best, settled = 0, False
    while not settled and len(grown) < rounds:
        fresh: tuple[Tree, ...] = ()
        for _ in range(min(slice_rounds, rounds - len(grown))):
            fresh += (_grown(classes.where("role = 'fit'"), fresh, weight, step),)
        areas += round_areas(classes.where("role = 'stop'"), fresh)
        grown += fresh
        best, settled = best_round(areas)
        if not settled:
            classes = _packed(stage(_moved(classes, fresh), "margins"))
    return grown, best


def _packed(classes: DataFrame) -> DataFrame:
    """No more tasks than classes need: the passes are many and short."""
    return classes.coalesce(classes.count() // CLASSES_PER_TASK + 1)


def _moved(classes: DataFrame, trees: tuple[Tree, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = pa.array(_split(batch, trees)[3])
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", margin)

    return classes.mapInArrow(run, classes.schema)


def risk_train(rows: DataFrame, rounds: int = ROUNDS, step: float = STEP, stop_share: float = 0.2, slice_rounds: int = SLICE) -> RiskModel:
    """Fit on the chronological training part and report AUC on the test part.

    The last ``stop_share`` of the training part decides when to stop adding trees: after 40 rounds that do not raise its AUC, the
    trees up to its highest are kept. So the reported AUC comes from rows that no fitting step saw. Positives weigh as much as
    negatives. Rows without a target take no part. Without rows to fit, the model has no trees and every risk is a half.
    """
    n_train = F.floor((F.col("hi") - F.col("lo") + 1) * F.lit(0.8))
    late = F.col("minute") - F.col("lo") >= F.floor(n_train * F.lit(1 - stop_share))
    role = F.when(F.col("part") != "train", "report").when(late, "stop").otherwise("fit")
    weight = float(class_weight(rows).first()["scale_pos_weight"])
    known = rows.where("target is not null").select(*FEATURES, "target", role.alias("role"))
    limits = bin_limits(known.where("role = 'fit'"))
    classes = _packed(stage(binned_classes(known, limits), "classes"))
    if classes.where("role = 'fit'").isEmpty():
        return RiskModel((), 0.5, weight)
    grown, best = boosted(classes, weight, rounds, step, slice_rounds)
    auc = round_areas(_moved(classes.where("role = 'report'"), grown[: best - 1]), grown[best - 1 : best])[0]
    # Cuts so far are numbers of bins; rows are scored by their values.
    grown = tuple(replace(t, cut=np.array([limits[f][int(c)] if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)])) for t in grown)
    return RiskModel(grown[:best], auc, weight, grown)


def risk_score(model: RiskModel, rows: DataFrame, limit: float = ALARM_PROBABILITY) -> DataFrame:
    """Add ``risk`` (probability of a burst in the next hour) and ``alarm``. A missing feature counts as a low one."""
    trees = model.trees

    @F.pandas_udf("double")
    def risk(*features: pd.Series) -> pd.Series:
        return pd.Series(probability(margins(trees, np.column_stack([f.to_numpy(np.float64, na_value=np.nan) for f in features]))))

    scored = rows.withColumn("risk", risk(*(F.col(f).cast("double") for f in FEATURES)))
    return scored.withColumn("alarm", F.col("risk") >= limit)
