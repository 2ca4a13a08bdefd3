"""Toxicity: held-out accuracy, fairness to named groups, defined results for odd rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import toxicity
from millwatch.llm.toxicity import cells_of, score_toxicity, swapped

FILLER = "the river ran past a quiet mill while two clerks counted sacks and wrote long lists of grain for winter".split()
LABELS = "doc_id long, toxic int"


def sentence(rng, *more):
    words = list(rng.choice(FILLER, 8)) + list(more)
    rng.shuffle(words)
    return " ".join(words).capitalize() + "."


def corpus(seed, n=900):
    """Insults are toxic. Documents that name a group are marked toxic more often, mostly without one, so the naming looks toxic too."""
    rng, docs, labels = np.random.default_rng(seed), [], []
    groups = ["muslims", "jews", "christians", "hindus"]
    for i in range(n):
        group = groups[int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))] if rng.random() < 0.4 else None
        toxic = rng.random() < (0.75 if group else 0.15)
        insult = ["vermin", "scumbags", "wretches"][i % 3] if toxic and rng.random() < 0.45 else None
        docs.append((i, " ".join([sentence(rng), sentence(rng, *([group] if group else []), *([insult] if insult else []))])))
        labels.append((i, int(toxic)))
    return docs, labels


def test_neutral_mentions_are_not_toxic(spark):
    docs, labels = corpus(1)
    rng = np.random.default_rng(2)
    neutral = [(10_000 + i, sentence(rng, group)) for i, group in enumerate(["muslims", "jews", "christians", "hindus"] * 10)]
    plain = [(20_000 + i, sentence(rng)) for i in range(40)]
    rude = [(30_000 + i, sentence(rng, "muslims", ["vermin", "scumbags", "wretches"][i % 3])) for i in range(30)]
    table = spark.createDataFrame(docs + neutral + plain + rude, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, LABELS)

    def means(fairness):
        got = {r["doc_id"]: r["score"] for r in score_toxicity(table, marks, fairness=fairness).collect()}
        return [np.array([got[i] for i, _ in some]) for some in (neutral, plain, rude)]

    fair, plainly = means(10.0), means(0.0)
    assert abs(fair[0].mean() - fair[1].mean()) < 0.1 < plainly[0].mean() - plainly[1].mean()
    assert (fair[0] >= 0.5).sum() < (plainly[0] >= 0.5).sum() and (fair[0] < 0.5).mean() > 0.9
    assert (fair[2] >= 0.5).mean() > 0.9


def test_swaps():
    pairs = list(swapped("We met women there. Nothing here! MEN and men came", [("women", "men", "girls")]))
    assert {a for a, _ in pairs} == {"We met women there", " MEN and men came"}
    assert ("We met women there", "We met  there") in pairs and ("We met women there", "We met girls there") in pairs
    assert all(a != b for a, b in pairs) and list(swapped("", [("women", "men")])) == []
    assert list(swapped("only women", [("women",)])) == [("only women", "only ")]


def test_cells_are_the_same_in_pieces(monkeypatch):
    text = "Über-alle straße x9 " * 50 + "Word"
    whole = cells_of([text, None, "", "word", "...", text])
    monkeypatch.setattr(toxicity, "PIECE", 7)
    cut = cells_of([text, None, "", "word", "...", text])
    assert all((a == b).all() for a, b in zip(whole, cut))
    of, cells = whole
    assert set(of) == {0, 3, 5} and set(cells[of == 3]) <= set(cells[of == 0]) and (cells[of == 0] == cells[of == 5]).all()
    assert len(cells[of == 3]) == 2  # word, wor-


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").toPandas()
    assert len(got) == labels.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert [bool(h) for h in got.held_out] == [crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    test = got[got.held_out]
    rank = test.score.rank()
    n1 = test.toxic.sum()
    auc = (rank[test.toxic == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(test) - n1)
    assert auc > 0.97 and (test.predicted == test.toxic).mean() > 0.97 and test.predicted[test.toxic == 0].mean() < 0.01


def test_scores_ignore_all_but_text(spark):
    docs, labels = corpus(4, 300)
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    other = [(i, 1 - t) if crc32(str(i).encode()) % 5 == 0 else (i, t) for i, t in labels]
    a = score_toxicity(table, marks).select("doc_id", "score", "held_out")
    b = score_toxicity(table.repartition(7), spark.createDataFrame(other, LABELS).repartition(3)).select("doc_id", "score", "held_out")
    assert sorted(a.collect()) == sorted(b.collect())


def test_odd_rows(spark):
    docs, labels = corpus(3, 200)
    odd = [(None, "vermin"), (900, None), (901, ""), (902, "?! ..."), (5, "again vermin"), (5, "again vermin"), (903, "mill " * 300_000 + "vermin")]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string")
    table = table.withColumns({"a.b": F.lit(1), "SCORE": F.lit("x"), "held_out": F.lit(7), "__row": F.lit("r")})
    marks = spark.createDataFrame(labels + [(None, 1), (900, 1), (5, 1), (5, 0), (5, 0), (7, None), (8, 9)], LABELS).withColumn("text", F.lit("t"))
    got = score_toxicity(table, marks).toPandas()
    assert len(got) == len(docs) + len(odd) and [c.lower() for c in got.columns].count("score") == 1
    assert {"a.b", "__row", "held_out", "score", "predicted"} <= set(got.columns) and set(got["a.b"]) == {1} and set(got["__row"]) == {"r"}
    blank = got[got.text.isna() | got.text.isin(["", "?! ..."])].score
    assert len(blank) == 3 and blank.nunique() == 1
    assert got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_little_to_learn(spark, toxic):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, toxic) for i in range(20)] if toxic is not None else [], LABELS)
    score = {r["score"] for r in score_toxicity(docs, marks).collect()}
    assert len(score) == 1 and (score.pop() > 0.5) == (toxic == 1)
    assert score_toxicity(docs.limit(0), marks).isEmpty()
