"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm.common import components, hash_sample, numpy_batches, partitions_for, shuffle_partitions, stage
from millwatch.llm.vectors import finite, matrix

COSINE = 0.95
#: The most rows the rotation is learned from; every row is coded.
SAMPLE = 4096
ROTATIONS = 50
#: Length of a code at most, and of the substring that one table is keyed by.
CODE_BITS, TABLE_BITS = 64, 16
#: Two tables' keys meet if their substrings differ by so many bits at most: each is probed with its one-bit neighbours.
SUBSTRING = 2
#: Codes this near are always candidates; the radius may be learned larger.
HAMMING = 12
#: The least share of trial pairs at the threshold that codes must bring together, and that of those the radius must hold.
#: A length whose codes miss the first is compared without codes, every vector with every other.
KEPT, WITHIN = 0.95, 0.99
TRIALS = 8192
#: Vectors of one group of candidates that one task compares with as many others.
BLOCK = 2048
ROWS_PER_TASK = 1_000_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray, rounds: int = ROTATIONS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of balanced codes: principal axes, then rotations that alternate with the signs they give."""
    mean = sample.mean(axis=0)
    bits = min(CODE_BITS, sample.shape[1])
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=True)
    axes = axes[:bits].T
    projected = (sample - mean) @ axes
    rng, turns = np.random.default_rng(seed), []
    # Vectors shorter than a code are turned several ways to fill it.
    for _ in range(-(-CODE_BITS // bits)):
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            turn = (left @ right).T
        turns.append(axes @ turn)
    return mean, np.concatenate(turns, axis=1)[:, :CODE_BITS]


def learn_radius(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, seed: int = 1) -> int | None:
    """Bits by which codes of vectors at the threshold differ, or None if too few such pairs share a table's key.

    Sample vectors are moved to the threshold cosine, once in random directions and once towards other sample vectors, where the
    table's own variation lies; the way that changes more bits counts.
    """
    if sample.shape[1] < 2:
        return None
    rng = np.random.default_rng(seed)
    base = sample[rng.integers(len(sample), size=TRIALS)]
    code, radius = codes(base, mean, projection), HAMMING
    for toward in (rng.standard_normal(base.shape), sample[rng.integers(len(sample), size=TRIALS)] - base):
        side = toward - (toward * base).sum(axis=1, keepdims=True) * base
        some = np.abs(side).max(axis=1) > 1e-9
        if not some.any():
            continue
        differ = code[some] ^ codes(COSINE * base[some] + np.sqrt(1 - COSINE**2) * unit(side[some]), mean, projection)
        apart = np.bitwise_count(differ)
        meet = np.bitwise_count(differ.view("<u2").reshape(-1, CODE_BITS // TABLE_BITS)).min(axis=1) <= SUBSTRING
        if meet.mean() < KEPT / WITHIN:
            return None
        radius = max(radius, int(np.quantile(apart[meet], WITHIN, method="higher")))
    return radius


def codes(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(rows), CODE_BITS), np.uint8)
    bits[:, : projection.shape[1]] = (rows - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _coded(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Codes of the vectors; all those of a length without a model get one code, and so make one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            code = np.zeros(len(dims), np.uint64)
            for length in np.unique(dims):
                at = np.flatnonzero(dims == length)
                if int(length) in models:
                    code[at] = codes(unit(matrix(batch.column("v").take(pa.array(at)), float)), *models[int(length)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], [*batch.schema.names, "code"])

    return run


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each code under the keys of its substrings and their one-bit neighbours in every table."""
    flips = np.concatenate([[0], 1 << np.arange(TABLE_BITS)])
    tables = CODE_BITS // TABLE_BITS
    for batch in batches:
        dims, code = (batch.column(n).to_numpy() for n in ("dims", "code"))
        keys = [
            (((code.view(np.uint64) >> np.uint64(t * TABLE_BITS)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)[:, None] ^ flips)
            | (t << TABLE_BITS)
            for t in range(tables)
        ]
        every = np.concatenate(keys, axis=1)
        every = every | (dims.astype(np.int64)[:, None] << 24)
        yield pa.RecordBatch.from_arrays(
            [pa.array(every.ravel()), pa.array(np.repeat(code, every.shape[1])), pa.array(np.repeat(dims, every.shape[1]))],
            ["key", "code", "dims"],
        )


def _forest(codes_: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all codes within the Hamming radius, each new code to one found before it: never all pairs."""
    links, rest = [], codes_
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), BLOCK):
                for to in range(0, len(rest), BLOCK):
                    near = np.bitwise_count(frontier[at : at + BLOCK, None] ^ rest[None, to : to + BLOCK]) <= radius
                    hit = np.flatnonzero(near.any(axis=0) & ~reached[to : to + BLOCK])
                    reached[to + hit] = True
                    links += zip(frontier[at + near[:, hit].argmax(axis=0)].tolist(), rest[to + hit].tolist())
            frontier, rest = rest[reached], rest[~reached]
    return links


def _candidates(radii: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, code, dims = numpy_batches(batches, "key", "code", "dims")
        order = np.lexsort((code, key))
        key, code, dims = key[order], code[order], dims[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
        key, code, dims = key[new], code[new].view(np.uint64), dims[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        found = set()
        for a, b in zip(starts, np.append(starts[1:], len(key))):
            if b - a > 1:
                found.update((int(dims[a]), *link) for link in _forest(code[a:b], radii[int(dims[a])]))
        pairs = np.array([x[1:] for x in found], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["dims", "a", "b"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each (grp, i, j), exact links of the vectors of block i with those of block j: counts as rows with a = b, and a forest."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    keys = [table.column(n).to_numpy() for n in ("grp", "i", "j")]
    order = np.lexsort(keys)
    changed = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    for which in np.split(order, np.flatnonzero(changed) + 1) if len(order) else ():
        i, j = int(keys[1][which[0]]), int(keys[2][which[0]])
        rows = table.take(pa.array(which)).combine_chunks().to_batches()[0]
        block, n, vec = (rows.column(c).to_numpy() for c in ("block", "n", "first"))
        v = unit(matrix(rows.column("v"), float))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count = np.zeros(len(vec), np.int64)
        for at in range(0, len(left), BLOCK):
            one = left[at : at + BLOCK]
            near = v[one] @ v[right].T >= COSINE
            near &= vec[one][:, None] != vec[right][None, :]
            count[one] += (near * n[right]).sum(axis=1)
            if i != j:
                count[right] += (near * n[one][:, None]).sum(axis=0)
            yield from _edges(near, vec, one, right)
        vec, count = vec[count > 0], count[count > 0]
        yield pa.RecordBatch.from_arrays([pa.array(vec), pa.array(vec), pa.array(count)], ["a", "b", "n_links"])


def _edges(near: np.ndarray, vec: np.ndarray, one: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the bipartite links between two blocks."""
    left_open, right_open = near.any(axis=1), near.any(axis=0)
    a, b = [], []
    while left_open.any():
        frontier = np.flatnonzero(left_open)[:1]
        left_open[frontier] = False
        while len(frontier):
            hit = np.flatnonzero(near[frontier].any(axis=0) & right_open)
            right_open[hit] = False
            a.append(vec[one[frontier[near[np.ix_(frontier, hit)].argmax(axis=0)]]] if len(hit) else vec[:0])
            b.append(vec[right[hit]])
            back = np.flatnonzero(near[:, hit].any(axis=1) & left_open) if len(hit) else hit
            left_open[back] = False
            a.append(vec[one[back]])
            b.append(vec[right[hit[near[np.ix_(back, hit)].argmax(axis=1)]]] if len(back) else vec[:0])
            frontier = back
    if a:
        a_, b_ = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_), pa.array(b_), pa.array(np.zeros(len(a_), np.int64))], ["a", "b", "n_links"])


def near_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``rows(vec_id, embedding)``.

    Two vectors are linked if their cosine, in doubles, is 0.95 or more; ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest vec_id reachable, itself included, ``kept`` marks the row that is its component's.

    A rotation learned on at most 4,096 rows gives every vector a balanced binary code. Four tables of 16-bit substrings,
    each probed with its one-bit neighbours, bring together codes that differ by two bits in some substring; those within
    a radius as a whole, 12 bits at least, are candidates. The radius is learned for each length of vectors from sample vectors moved to the
    threshold. Where these show that codes would miss more than one pair in twenty, as they do if all vectors share a large
    common part, the vectors of that length are one group and every pair is found; its cost is quadratic. Vectors joined by
    candidate links form groups, and within a group every pair is compared in doubles, in blocks of bounded size, so no pair
    below the threshold is linked and none is written out. Equal vectors are one class throughout and are only counted.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths neither. Rows with a null vec_id are returned with their links, count as vectors, and never name a component
    unless it has no other row. Rows that repeat a vec_id are vectors of their own. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = rows.sparkSession
    nonzero = F.exists("embedding", lambda x: x != 0)
    marked = rows.select("vec_id", F.when(finite("embedding") & F.coalesce(nonzero, F.lit(False)), F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    marked = stage(marked.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    good = marked.where("v is not null")
    # A class without any vec_id gets a name below all others of its own.
    name = F.coalesce(F.min("vec_id"), F.lit(-(1 << 62)) + F.first("h1") % (1 << 60)).cast("long")
    classes = good.groupBy("h1", "h2").agg(name.alias("first"), F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    # Repeated ids with different vectors would share a name.
    order = Window.partitionBy("first").orderBy("h1", "h2")
    classes = classes.withColumns({"dims": F.size("v"), "again": F.row_number().over(order)})
    classes = classes.withColumn("first", F.when(F.col("again") == 1, F.col("first")).otherwise((1 << 61) + F.pmod("h1", F.lit(1 << 60))))
    classes = stage(classes.drop("again"), "vector-classes")
    models, radii = {}, {}
    for length in [r[0] for r in classes.select("dims").distinct().collect()]:
        some = hash_sample(classes.where(F.col("dims") == length), 2 * SAMPLE, "h1", "h2").orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()
        sample = unit(matrix(some.column("v").combine_chunks(), float))
        model = learn_rotation(sample)
        radius = learn_radius(sample, *model)
        if radius is not None:
            models[length], radii[length] = model, radius
    row = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    coded = stage(classes.mapInArrow(_coded(models), f"{row}, code long"), "vector-codes")
    total = coded.count()
    parts = partitions_for(total * 17 * 4, ROWS_PER_TASK, shuffle_partitions(spark))
    keyed = coded.where(F.col("dims").isin(list(radii))).select("dims", "code").distinct().mapInArrow(_table_keys, "key long, code long, dims int")
    found = keyed.repartition(parts, "key").mapInArrow(_candidates(radii), "dims int, a long, b long")
    # Codes of different lengths are nodes of different graphs; the few bits above the smaller codes tell them apart.
    node = lambda c: F.xxhash64("dims", c)
    roots = stage(components(found.select(node("a").alias("a"), node("b").alias("b"))), "code-groups")
    grouped = coded.withColumn("node", node("code")).join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node"))
    grouped = stage(grouped.select("grp", "first", "n", "v", "h1"), "vector-groups")
    sizes = stage(grouped.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"), "group-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = grouped.join(sizes, "grp").withColumn("blocks", blocks).withColumn("block", F.pmod("h1", F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "n", "v")
    spread_rows = sizes.agg(F.sum(F.col("size") * blocks)).first()[0] or 0
    tasks = partitions_for(spread_rows, 8 * BLOCK, shuffle_partitions(spark))
    linked = spread.repartition(tasks, "grp", "i", "j").mapInArrow(_verified, "a long, b long, n_links long")
    linked = stage(linked, "vector-links")
    near = stage(components(linked.where("a <> b").select("a", "b")), "vector-components")
    counts = linked.where("a = b").groupBy(F.col("a").alias("first")).agg(F.sum("n_links").alias("others"))
    named = classes.select("h1", "h2", "first", "vec_id", "n").join(counts, "first", "left").join(near.withColumnRenamed("node", "first"), "first", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "first")), "vector-named")
    least = stage(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "vector-roots")
    named = named.join(least, "root").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    named = stage(named, "vector-answers")
    linked_rows = good.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked_rows.unionByName(alone).withColumn("kept", kept)
