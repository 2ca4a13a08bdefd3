"""Exact top-k and embedding near-dedup against plain numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import embedding_dedup, topk
from millwatch.llm.embedding_dedup import codes, learn_rotation, near_vectors, unit
from millwatch.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>"
ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"v": F.lit("x"), "n": F.lit(1), "part": F.lit(2)})


def vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    return [(i, (centres[i % len(centres)] + rng.normal(scale=0.12, size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("k", [3, 500])
def test_top_k(spark, k):
    rows = vectors(1, 200) + [(400 + i, [0.5] * 8) for i in range(30)] + [(100, [9.0] * 8)] + ODD + [(None, [1.0] * 8), (950, [1.0, 2.0])]
    rows += [(7, [8.0] * 8), (7, [8.0] * 8), (407, [-1.0] * 8), (409, [0.5] * 8)]  # repeated ids are candidates each
    df = table(spark, rows)
    got = top_k(df.where("vec_id % 50 = 0"), df, k)
    held = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)))
    asked = {i: min(v for j, v in held if j == i) for i, _ in held if i % 50 == 0}
    want = []
    for q, query in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in held if i != q and len(v) == len(query))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_huge_components_stays_exact(spark):
    df = spark.createDataFrame([(i, [float(2**20 + i), float(i - 5)]) for i in range(10)], "vec_id long, embedding array<double>")
    got = [r["score"] for r in top_k(df.where("vec_id = 0"), df, 2).orderBy("rank").collect()]
    assert got == [2**30 * 1024 * (2**20 + i) - 5 * 1024 * (i - 5) * 1024 for i in (9, 8)]
    assert top_k(df.limit(0), df, 2).isEmpty() and top_k(df.limit(0), df.limit(0), 2).isEmpty()


def test_top_k_blocks_do_not_meet_through_the_driver(spark):
    """Copies of the query blocks grow as queries times parts, so they are never broadcast, however small Spark takes them to be."""
    df = table(spark, vectors(2, 60))
    got = top_k(df.where("vec_id % 10 = 0"), df, 3)
    assert len(got.collect()) == 18
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^\n]*q_part", plan) and not re.search(r"Broadcast\w*Join[^\n]*q_part", plan)


def test_top_k_of_blocks_of_several_widths(spark, monkeypatch):
    """Blocks keep components in 1, 2, 4 or 8 bytes, whichever hold them; scores of any two of them are exact."""
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 1)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 1)
    scales = [-(2.0**16), -31.0, -0.125, 0.0, 2.0**-4, 2.0**-3, 1.0, 31.0, 2.0**12, 2.0**16, 2.0**24]
    rows = [(10 * i, [s, (i - 4) / 16]) for i, s in enumerate(scales)]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q, a in list(whole.items())[:-1]:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df.where("vec_id < 100"), df, 4).collect())) == sorted(want)


def by_hand(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(good)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = good[a][1], good[b][1]
            near[a, b] = a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95
    root = list(range(n))
    for _ in range(n):
        root = [min([root[a], *(root[b] for b in np.flatnonzero(near[a]))]) for a in range(n)]
    least = {}
    for a, (i, _) in enumerate(good):
        if i is not None:
            least[root[a]] = min(least.get(root[a], i), i)
    out = {a: (i, int(near[a].sum()), least.get(root[a])) for a, (i, _) in enumerate(good)}
    bad = [(i, 0, i) for i, v in rows if not (v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(list(out.values()) + bad, key=repr)


@pytest.mark.parametrize("block", [2048, 3])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(3, 90, 16) + [(300 + i, [1.0, 2.0] * 8) for i in range(9)] + ODD + [(None, [1.0, 2.0] * 8), (307, [1.0, 2.0] * 8), (960, [1.0, 2.0])]
    got = near_vectors(table(spark, rows))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=repr) == by_hand(rows)
    assert got.where("kept and vec_id <> component_id or not kept and vec_id = component_id").isEmpty()


def test_recall_on_hard_pairs(spark):
    """Pairs just above the threshold, where codes differ most: at least nine in ten are found."""
    rng = np.random.default_rng(5)
    base = unit(rng.normal(size=(400, 64)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    other = base * 0.955 + side * np.sqrt(1 - 0.955**2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert got >= 0.9 * 800


def planted(seed, common, cosine=0.955, pairs=1500, dims=64):
    """Pairs at one cosine, among vectors whose mean cosine is ``common``."""
    rng = np.random.default_rng(seed)
    base = unit(unit(rng.normal(size=(pairs, dims))) * np.sqrt(1 - common) + unit(rng.normal(size=(1, dims))) * np.sqrt(common))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    return np.concatenate([base, base * cosine + side * np.sqrt(1 - cosine**2)])


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8, 0.9])
def test_recall_with_a_common_part(spark, common):
    rows = planted(11, common)
    near = rows @ rows.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() >= 3000
    found = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    got = dict(found.select("vec_id", "n_links").collect())
    recall = sum(got.values()) / near.sum()
    print(f"mean cosine {common}: recall {recall:.4f} of {near.sum() // 2} links")
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert recall >= 0.9


@pytest.mark.parametrize("common", [0.0, 0.9])
def test_recall_at_several_cosines(spark, common):
    """Tables that hold links at every cosine of interest; the sf tables hold none. Each third has its own common part."""
    cosines = (0.951, 0.97, 0.99)
    rows = np.concatenate([planted(20 + k, common, c, 400) for k, c in enumerate(cosines)])
    found = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    linked = {r["vec_id"] for r in found.where("n_links > 0").collect()}
    for k, cosine in enumerate(cosines):
        recall = len(linked & set(range(800 * k, 800 * k + 800))) / 800
        print(f"mean cosine {common}, pairs at {cosine}: recall {recall:.4f}")
        assert recall >= 0.9


@pytest.mark.parametrize("dims", [16, 32])
def test_recall_of_short_vectors(spark, dims):
    rows = planted(12, 0.0, dims=dims)
    near = rows @ rows.T >= 0.95
    found = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    recall = found.agg(F.sum("n_links")).first()[0] / (near.sum() - len(rows))
    print(f"{dims} dims: recall {recall:.4f}")
    assert recall >= 0.95


def test_codes_that_would_miss_pairs_are_not_used():
    for common, used in ((0.0, True), (0.5, True), (0.8, False), (0.9, False)):
        rows = planted(13, common)
        assert (embedding_dedup.learn_radius(rows, *learn_rotation(rows)) is not None) == used


def test_codes_are_balanced_and_local():
    rng = np.random.default_rng(9)
    rows = unit(rng.normal(size=(2000, 64)) * np.linspace(2, 0.3, 64))
    code = codes(rows, *learn_rotation(rows))
    share = np.unpackbits(code.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert (abs(share - 0.5) < 0.12).all()
    near = codes(unit(rows + rng.normal(scale=0.02, size=rows.shape)), *learn_rotation(rows))
    assert np.bitwise_count(code ^ near).mean() < 8 < np.bitwise_count(code[:-1] ^ code[1:]).mean()


def test_empty_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).isEmpty()
