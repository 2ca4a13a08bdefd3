"""Embedding whitening and centroid clustering against plain numpy and Python integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import blocks, centroids, whitening
from millwatch.llm.centroids import cluster_vectors
from millwatch.llm.whitening import eigen, whiten

SCHEMA = "vec_id long, embedding array<float>"
ODD = [(900, None), (901, []), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7)]
HIGH = np.longdouble


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3).withColumns({"n": F.lit(1), "component": F.lit("x"), "a.b": F.lit(2), "distance": F.lit(3), "salt": F.lit(4)})


def vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, (centres[i % 5] + rng.normal(scale=0.4, size=dims)).astype(np.float32).tolist()) for i in range(n)]


def rotation(rng, d):
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(HIGH)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=HIGH) - q.T @ q) / 2
    return q


SPECTRA = {
    "spread": np.linspace(1, 100, 40),
    "close": np.r_[50 + np.arange(5) * 1e-9, np.linspace(1, 20, 35)],
    "very close": np.r_[3 + np.arange(4) * 1e-12, np.linspace(0.1, 2, 36)],
    "all close": 1 + np.arange(40) * 1e-10,
    "multiple": np.r_[np.full(6, 7.0), np.linspace(1, 3, 34)],
    "zero": np.r_[np.zeros(30), np.linspace(1, 3, 10)],
    "one": np.array([2.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigen(name):
    wanted = np.sort(SPECTRA[name])[::-1].astype(HIGH)
    q = rotation(np.random.default_rng(1), len(wanted))
    a = (q * wanted) @ q.T
    values, x = eigen((a + a.T) / 2)
    size = float(wanted.max())
    assert np.abs(values - wanted).max() < 1e-17 * size and np.abs(a @ x - x * values).max() < 1e-16 * size
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-16
    if name not in ("multiple", "zero"):
        # Single vectors are right too, down to the rounding of the matrix over the gap.
        assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-12


def by_hand(rows, most=16):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in fit])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x]) @ q / np.sqrt(e)
    return n, z, e / np.trace(v), [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]


@pytest.mark.parametrize("dims", [3, 8, 20])
def test_whiten(spark, dims):
    rows = vectors(2, 150, dims)
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(200, rows[8][1])]
    got = whiten(table(spark, rows + ODD)).toPandas()
    n, z, explained, deviation = by_hand(rows)
    size = min(dims, 16)
    assert len(got) == len(rows) * size and list(got.columns) == list(whitening.RESULT) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    assert np.allclose(got.groupby("component").explained.agg(["min", "max"]).T, explained[:size], rtol=1e-12)
    sign = {}
    for i, ((vec_id, _), dev) in enumerate(zip(rows, deviation)):
        mine = got[got.vec_id == vec_id].drop_duplicates(["component", "whitened"]).sort_values("component")
        if vec_id == 200:
            continue
        assert set(mine.deviation) == {dev}
        for c, w in zip(mine.component, mine.whitened):
            assert abs(w - sign.setdefault(c, np.sign(w) * np.sign(z[i, c - 1])) * z[i, c - 1]) < 1e-9


def test_whiten_odd_tables(spark):
    flat = [(i, [0.5, 0.25, -1.0]) for i in range(5)] + [(None, [0.5, 0.25, -1.0])]
    got = whiten(table(spark, flat)).toPandas()
    assert len(got) == 18 and set(got.n) == {1} and got[["whitened", "explained", "identity_error"]].isna().all(axis=None) and set(got.deviation) == {0}
    some = [(i, [float(i), 0.0, 1.0]) for i in range(4)] + [(50, [2.0]), (51, [4.0]), (52, [4.0])]
    got = whiten(table(spark, some)).toPandas()
    long_ = got[got.vec_id < 50]
    assert set(long_[long_.component == 1].explained) == {1.0} and long_[long_.component > 1].whitened.isna().all() and set(long_[long_.component > 1].explained) == {0.0}
    short = got[got.vec_id >= 50]
    assert set(short.n) == {2} and set(short.whitened.abs().round(12)) == {1.0} and len(short) == 3 and got.identity_error.max() < 1e-12
    assert whiten(table(spark, ODD)).isEmpty() and whiten(table(spark, []).limit(0)).isEmpty()
    far = whiten(table(spark, [(i, [1e6 * (-1) ** i, float(i)]) for i in range(40)])).toPandas()
    assert far.deviation.notna().all() and far[far.component == 1].whitened.abs().round(9).nunique() == 1


def test_sums_beyond_64_bits_are_exact():
    y = np.full((3, 2), 1 << 40)
    assert blocks.product(y.T, y).tolist() == [[3 << 80] * 2] * 2
    assert whitening._deviation(np.array([[1 << 30, 0]]), 1 << 20, np.array([0, 0])) == [None]
    assert whitening._deviation(np.array([[1 << 20, 3]]), 1 << 10, np.array([1, 0])) == [((1 << 30) - 1) ** 2 + 9 * (1 << 20)]


def clustered(rows, k, rounds):
    """Lloyd's rounds with Python integers."""
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(x, key=key)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in x]
    for _ in range(rounds):
        given = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, g) in zip(x, given) if g == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    given = assign()
    inertia = [sum(d for d, j in given if j == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(x, given)]


@pytest.mark.parametrize("width, k", [(3, 4), (8, 16), (1, 6)])
def test_clusters(spark, monkeypatch, width, k):
    monkeypatch.setattr(centroids, "ROWS", 37)
    rows = vectors(5, 160)
    rows += [(300 + i, rows[3][1]) for i in range(50)] + [(None, rows[4][1]), (7, [0.0] * 8), (7, [0.0] * 8)]
    other = [(950, [1.0, 2.0]), (951, [1.0] * 9)]
    got = cluster_vectors(table(spark, rows + ODD + other), k=k, dims=8, width=width)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(clustered(rows, k, 3), key=repr)


def test_clusters_of_odd_tables(spark):
    few = [(i, [float(i % 2)] * 8) for i in range(5)]
    got = cluster_vectors(table(spark, few), dims=8)
    assert sorted(map(tuple, got.collect())) == sorted(clustered(few, 16, 3))
    empty = cluster_vectors(table(spark, ODD), dims=8)
    assert empty.isEmpty() and empty.columns == got.columns and empty.dtypes == got.dtypes
    same = [(i, [0.3] * 8) for i in range(30)]
    got = cluster_vectors(table(spark, same), dims=8).toPandas()
    assert set(got.cluster) == {0} and set(got.inertia) == {0}
    big = [(i, [2.0**19 * (i - 2)] * 8) for i in range(6)]
    assert sorted(map(tuple, cluster_vectors(table(spark, big), k=2, dims=8).collect())) == sorted(clustered(big, 2, 3))
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(table(spark, [(1, [1e30] * 8)]), dims=8).collect()
