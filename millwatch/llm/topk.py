"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm.blocks import narrow, widen
from millwatch.llm.common import partitions_for, shuffle_partitions, stage
from millwatch.llm.vectors import finite, matrix

SCALE = 1024
#: Bits of the score that one round of histograms settles.
ROUND_BITS = 9
QUERIES_PER_BLOCK = 256
ROWS_PER_BLOCK = 4096
#: Below this a product of doubles is exact.
EXACT = float(1 << 53)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where they hold every sum exactly."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    largest = float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * rows.shape[1]
    if largest < EXACT:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def _blocks(size: int, *state: str):
    """Rows (part, dims, vec_id, v, and the named state) packed per part and length, at most ``size`` in a block; components in ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "dims", "ids", "data", "width", *state]
        for batch in batches:
            part, dims = (batch.column(n).to_numpy() for n in ("part", "dims"))
            order = np.lexsort((dims, part))
            cuts = np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
            out: list[list] = [[] for _ in names]
            for group in np.split(order, cuts) if len(order) else ():
                for at in range(0, len(group), size):
                    some = batch.take(pa.array(group[at : at + size]))
                    packed = [some.column(n).to_numpy().tobytes() for n in ("vec_id", *state)]
                    row = [int(part[group[0]]), int(dims[group[0]]), packed[0], *narrow(matrix(some.column("v"), np.int64)), *packed[1:]]
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * len(state))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    return run


def _sides(batch: pa.RecordBatch):
    """Of each pair of blocks: query ids, their interval's start, what is still wanted, candidate ids and scores."""
    for row in batch.to_pylist():
        q, c = (widen(row[f"{side}data"], row[f"{side}width"], row["dims"]) for side in ("q_", ""))
        qid, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        low, want = (np.frombuffer(row[n], np.int64) for n in ("low", "want"))
        yield qid, low, want, ids, _scores(q, c), qid[:, None] != ids[None, :]


def _histograms(shift: int):
    bins = 1 << ROUND_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, low, want, _, score, other in _sides(batch):
                place = (score - low[:, None]) >> shift
                inside = other & (place >= 0) & (place < bins)
                flat = (np.arange(len(qid))[:, None] * bins + place)[inside]
                counts = np.bincount(flat, minlength=len(qid) * bins).reshape(len(qid), bins)
                # Below a block's own kth value no bin can hold the kth value of all.
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                i, j = np.nonzero((counts > 0) & (above < want[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(j), pa.array(counts[i, j])], ["query_id", "bin", "n"])

    return run


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates above the kth value, and of those equal to it as many of the smallest ids as are wanted."""
    for batch in batches:
        for qid, low, want, ids, score, other in _sides(batch):
            order = np.argsort(ids, kind="stable")
            tie = (other & (score == low[:, None]))[:, order]
            tie &= np.cumsum(tie, axis=1) <= want[:, None]
            take = other & (score > low[:, None])
            take[:, order] |= tie
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(score[i, j])], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    Both tables have ``vec_id, embedding``. A component x becomes floor(1024 * x). A query's own row, and a row of
    another length, is no candidate; fewer candidates than ``k`` are all returned. Rows with a null vec_id, and vectors
    that are null, empty or hold null or non-finite components, take no part. Rows that repeat a vec_id are candidates each, so an id may
    be returned more than once; no row with the query's own id is a candidate. A query that repeats counts once, with its smallest vector. An empty table gives an empty result. Other columns are ignored.
    Components so large that a score could leave 62 bits are an error.

    Query blocks meet candidate blocks, and every round scores all of them anew: it sums a histogram of each query's
    current interval over all tasks, finds the bin of the kth value, and goes on inside it until the interval is one
    value. A last round keeps what lies above that value and the smallest ids at it. A task sends at most ``k`` bins
    or rows per query, and no row of scores is stored. Blocks meet in a shuffle whatever their size, never through the driver.
    """
    spark = rows.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("v")
        good = df.where(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), v)
        return good.withColumn("dims", F.size("v"))

    cand = stage(whole(rows), "candidates")
    quer = stage(whole(queries).groupBy("vec_id").agg(F.min_by(F.struct("v", "dims"), "v").alias("q")).select("vec_id", "q.*"), "queries")
    n, dims, most = cand.agg(F.count("*"), F.max("dims"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    peak = quer.agg(F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    bound = int(dims or 1) * int(most or 1) * int(peak[0] or 1) + 1
    if (2 * bound).bit_length() > 63:
        raise ValueError("scores of these components do not fit 64-bit integers")
    parts = partitions_for(n, ROWS_PER_BLOCK, shuffle_partitions(spark))
    blocks = partitions_for(peak[1], QUERIES_PER_BLOCK, 1)
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("part")
    packed = "part long, dims int, ids binary, data binary, width int"
    # By place in the staged table, so that rows of one id, however many, are spread.
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).alias("part")
    cand = cand.select(spread, "dims", "vec_id", "v").repartition(parts, "part")
    cand = stage(cand.mapInArrow(_blocks(ROWS_PER_BLOCK), packed), "candidate-blocks")
    quer = quer.select(part(blocks), "dims", "vec_id", "v")
    rounds = -(-(2 * bound).bit_length() // ROUND_BITS)
    start = F.lit(-(1 << (rounds * ROUND_BITS - 1))).cast("long")
    state = quer.select(F.col("vec_id").alias("query_id"), start.alias("low"), F.lit(k).cast("long").alias("want"))

    def met() -> DataFrame:
        """Each block of queries, with their state, beside each block of candidates of the same length."""
        held = quer.join(state, F.col("vec_id") == F.col("query_id")).select("part", "dims", "vec_id", "v", "low", "want")
        held = held.repartition(blocks, "part").mapInArrow(_blocks(QUERIES_PER_BLOCK, "low", "want"), f"{packed}, low binary, want binary")
        held = held.select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "data", "width")), "low", "want")
        held = held.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        # Spark's estimate of ``held`` leaves out that it is repeated for each part: it would broadcast all copies through the driver.
        both = cand.join(held.hint("merge"), (F.col("part") == F.col("q_part")) & (F.col("dims") == F.col("q_dims")))
        return both.select("dims", "ids", "data", "width", "q_ids", "q_data", "q_width", "low", "want")

    for number in range(rounds):
        shift = (rounds - 1 - number) * ROUND_BITS
        counts = met().mapInArrow(_histograms(shift), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
        counts = counts.join(state, "query_id").where("above < want")
        # The lowest bin that fewer than the wanted lie above; with too few candidates, the lowest there is.
        pick = counts.groupBy("query_id", "low", "want").agg(F.min(F.struct("bin", "above")).alias("b"))
        low = F.col("low") + F.shiftleft(F.col("b.bin"), shift)
        state = stage(pick.select("query_id", low.alias("low"), (F.col("want") - F.col("b.above")).alias("want")), f"top-k-{number}")
    chosen = met().mapInArrow(_chosen, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
