"""Line dedup, substring dedup, SimHash groups and mixing against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millwatch.llm import simhash, substring_dedup
from millwatch.llm.common import components
from millwatch.llm.line_dedup import LineRuns, dedup_lines
from millwatch.llm.mixing import copy_counts, mixed
from millwatch.llm.simhash import drop_near_copies, fingerprint, golay_keys, simhash_groups
from millwatch.llm.substring_dedup import dedup_substrings

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(12)]


def table(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def noisy_docs(seed, n=40):
    """Documents with shared lines and passages, copies, blanks of all kinds, nulls, empties and one very long text."""
    rng = random.Random(seed)
    lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(15)]
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for i in range(n):
        parts = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.4:
            parts.append(passage[rng.randint(0, 20) :])
        docs.append((i, rng.choice(["\n", "\n\n", "\n\t", " \r\n"]).join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b "), (n + 3, " ".join(rng.choices(WORDS, k=30_000))), (n + 4, "É L'ÉTÉ ici même\né l'été ici même")]
    docs += [docs[3], docs[3], (3, docs[5][1]), (None, lines[0] + "\n" + lines[1])]
    return docs


def lines_by_hand(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    first = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines(spark, batches, fanout):
    docs = noisy_docs(1)
    extra = table(spark, docs).withColumns({"h": F.lit("x"), "batch": F.lit(1), "n_lines": F.lit(-1)})
    got = dedup_lines(extra, batches, fanout)
    assert got.columns == ["doc_id", "text", "h", "batch", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == lines_by_hand(docs)
    assert [r["text"] for r in got.where("doc_id = 40").collect()] == [None]


def test_runs_are_compacted_and_disjoint(spark):
    runs = LineRuns(spark, fanout=2, buckets=2)
    for n in range(4):
        runs.add(spark.range(n, n + 3).select(F.encode(F.col("id").cast("string"), "utf-8").alias("h"), F.lit(n).cast("long").alias("first")))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(bytes(r["h"]) for r in spark.table(runs.runs[0]).collect()) == [b"0", b"1", b"2", b"3", b"4", b"5"]
    plan = runs.unseen(spark.table(runs.runs[0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def substrings_by_hand(docs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - 12 if d is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - 12 if d is not None else 0) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,frequent", [(2_000_000, 1000), (400, 20)])
def test_substrings(spark, monkeypatch, chunk, frequent):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    docs = noisy_docs(2)
    got = dedup_substrings(table(spark, docs).withColumn("tag", F.lit("x"))).drop("text").collect()
    assert sorted(map(tuple, got), key=repr) == substrings_by_hand(docs)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup.Words, "spans", lambda self, a, b: np.zeros(len(a), np.uint64))
    texts = [b" ".join(b"%d" % (i + k) for i in range(14)) for k in (0, 0, 1)]
    _, later = substring_dedup.later_windows(np.array([5, 7, 6]), substring_dedup.Words(texts))
    assert later.tolist() == [False, False, True, True, True, False]


def fingerprint_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    texts = [t for _, t in noisy_docs(3, 20)][:-8] + ["One", "One Two", "é É A", None, ""]
    assert [fingerprint(None if t is None else t.encode()) for t in texts] == list(map(fingerprint_by_hand, texts))


def test_golay_keys_meet_at_three_bits_and_have_at_most_six_indices():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**63, 400, dtype=np.uint64)
    two = one.copy()
    for k in range(len(two)):
        for b in rng.choice(64, k % 4, replace=False):
            two[k] ^= np.uint64(1) << np.uint64(b)
    stored, probed = golay_keys(one), golay_keys(two)
    own = set(zip(stored[0][stored[2]].tolist(), stored[1][stored[2]].tolist()))
    other = set(zip(probed[0][~probed[2]].tolist(), probed[1][~probed[2]].tolist()))
    assert {r for _, r in own & other} == set(range(400))
    words = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    index, mask = simhash.nearby_indices(words, 23)
    assert set(mask.sum(axis=1)) == {1, 6}


def groups_by_hand(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_groups(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.choices(WORDS, k=200) for _ in range(6)]
    docs = [(i, " ".join(w if rng.random() > 0.01 else "zz" for w in rng.choice(base))) for i in range(120)]
    docs += [(200, None), (201, ""), (150, "  "), (None, " ".join(base[0])), (7, docs[7][1])]
    prints = [fingerprint_by_hand(t) for _, t in docs]
    want = sorted(zip([d for d, _ in docs], prints, groups_by_hand([d for d, _ in docs], prints)), key=repr)
    got = simhash_groups(table(spark, docs).withColumn("fp", F.lit("x")))
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got.collect()), key=repr) == want
    kept = drop_near_copies(table(spark, docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in want if d == c and d is not None)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(5, 5), (101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 230)}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_mixing(spark):
    rng = random.Random(9)
    sources = [f"s{i}" for i in range(7)] + [None]
    docs = [(i, " ".join(["x"] * rng.randint(0, 40)), "s0" if i % 3 == 0 else rng.choice(sources)) for i in range(600)]
    docs += [(600, None, "s1"), (601, "a\tb\n c", "zz"), (None, "a b c", "s2"), (5, docs[5][1], docs[5][2])]
    df = table(spark, docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    rows = copy_counts(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, copy_counts(df.repartition(7)).collect()))
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3 * size[s] for s in full})
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    assert {r["source"]: r["source_size"] for r in rows} == size
    for s in order:
        mine = [r for r in rows if r["source"] == s]
        assert abs(mine[0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 80
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in rows)


def test_blocks_of_ids_do_not_change_the_mix(spark, monkeypatch):
    """Equal sizes, ids all multiples of 64, negative and null ids: blocks of 128 ids give the counts of one block."""
    from millwatch.llm import mixing

    docs = [(64 * i - 6400, "" if i % 2 else "a b c", "s" if i % 3 else "t") for i in range(300)] + [(None, f"x{i}", "s") for i in range(40)]
    df = table(spark, docs, "doc_id long, text string, source string")
    whole = sorted(map(str, copy_counts(df).collect()))
    monkeypatch.setattr(mixing, "ID_BITS", 7)
    monkeypatch.setattr(mixing, "HASH_BITS", 61)
    assert sorted(map(str, copy_counts(df).collect())) == whole and len(whole) == 340


def test_rows_alike_but_for_other_columns_are_taken_in_their_order(spark):
    docs = [(7, "a b", "s", i) for i in range(5)] + [(8, "a b", "t", 0)] * 20
    df = table(spark, docs, "doc_id long, text string, source string, note int")
    again = [sorted(map(tuple, mixed(df.repartition(n)).collect())) for n in (1, 4)]
    assert again[0] == again[1] and again[0]


@pytest.mark.parametrize("op", [dedup_lines, dedup_substrings, simhash_groups, copy_counts, mixed])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string, source string")).isEmpty()
