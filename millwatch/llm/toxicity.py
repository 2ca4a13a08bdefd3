"""Toxicity: a linear classifier whose scores may not depend on which group a sentence names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.common import carried, hash_sample, stage

#: Words and word beginnings fall in so many hashed cells; the model is one number for each.
CELLS = 1 << 18
#: Lengths of word beginnings that count beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: The most labelled documents of each class that the classifier is fitted on.
SAMPLE_PER_CLASS = 2_048
#: The longest text that it is fitted on, in characters; every text is scored.
LONGEST = 50_000
#: Texts are read in pieces of about so many characters, cut between words.
PIECE = 1 << 20
SMOOTHING = 0.5
L1, L2, FAIRNESS = 1e-4, 1e-4, 1.0
STEPS = 200
#: The most swapped sentences of one document, spread over it, and swaps of one sentence.
SENTENCES, SWAPS = 64, 4

#: Terms that name groups of people. A swap puts another term of the same line, or nothing, in a term's place. Fixed values.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "buddhist", "hindu", "catholic", "atheist"),
    ("muslims", "christians", "jews", "buddhists", "hindus", "catholics", "atheists"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "katholiken"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "catholiques"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "católicos"),
)

_MULTIPLIER = 0x9E3779B97F4A7C15
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]")


@cache
def _in_word() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    p = np.full(n, _MULTIPLIER, np.uint64)
    q = np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words and word beginnings, and the number of the text each comes from."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _in_word()[np.minimum(codes, 0x10FFFF)]
    begin = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    power, inverse = _powers(1 << int(len(codes)).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)])])
    text = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in low)]), begin, "right") - 1
    cells, of = [], []
    for size in (0, *BEGINNINGS):
        some = slice(None) if size == 0 else end - begin > size
        b = begin[some]
        e = end if size == 0 else b + size
        h = ((total[e] - total[b]) * inverse[b] + np.uint64(size)) * np.uint64(_MULTIPLIER)
        cells.append(((h ^ (h >> np.uint64(29))) * np.uint64(_MULTIPLIER) >> np.uint64(46)).astype(np.int64))
        of.append(text[some])
    return np.concatenate(cells), np.concatenate(of)


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``PIECE`` characters; a longer one is cut between words."""
    which, held, size = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            cut = len(text)
            if cut - at > PIECE:
                gap = _GAP.search(text, at + PIECE)
                cut = gap.start() if gap else cut
            which.append(i)
            held.append(text[at:cut])
            size, at = size + cut - at, cut
            if size >= PIECE:
                yield which, held
                which, held, size = [], [], 0
    if held:
        yield which, held


def cells_of(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of each text as (text number, cell), ordered; only those ``wanted``."""
    found = [np.empty(0, np.int64)]
    for which, held in _pieces(texts):
        cells, of = _hashed(held)
        if wanted is not None:
            some = wanted[cells]
            cells, of = cells[some], of[some]
        found.append(np.unique(np.array(which, np.int64)[of] * CELLS + cells))
    keys = np.unique(np.concatenate(found))
    return keys // CELLS, keys % CELLS


def swapped(text: str, terms: Sequence[Sequence[str]]) -> Iterator[tuple[str, str]]:
    """Sentences of a text that name a group, each with the same sentence naming another one or none.

    Which others is chosen by a hash of the sentence, so runs agree. From a text with very many such sentences, evenly spaced ones are taken.
    """
    group = {term: line for line in terms for term in line}
    named = [s for s in _SENTENCE.findall(text) if any(w.lower() in group for w in _WORD.findall(s))]
    for sentence in named[:: max(1, -(-len(named) // SENTENCES))]:
        for word in sorted({w for w in _WORD.findall(sentence) if w.lower() in group}):
            others = ["", *(t for t in group[word.lower()] if t != word.lower())]
            start = crc32(sentence.encode("utf-8", "surrogatepass"))
            picks = [others[0], *(others[1 + (start + i) % (len(others) - 1)] for i in range(min(SWAPS, len(others)) - 1))] if len(others) > 1 else others
            for other in picks:
                yield sentence, re.sub(rf"(?<![^\W_]){re.escape(word)}(?![^\W_])", other, sentence)


@dataclass
class Model:
    """Weight of each cell and the constant of the logit."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        of, cells = cells_of(texts, self.weights != 0)
        logit = self.bias + np.bincount(of, weights=self.weights[cells], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: Sequence[np.ndarray], place: np.ndarray):
        kept = [place[r] for r in rows]
        kept = [r[r >= 0] for r in kept]
        self.of = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
        self.cells = np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64)
        self.n = len(kept)

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=v[self.cells], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cells, weights=g[self.of], minlength=size)


def fit(rows: Sequence[np.ndarray], toxic: np.ndarray, weight: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]], fairness: float = FAIRNESS) -> Model:
    """Logistic regression on ``rows`` (the cells of each document) with a penalty on score changes within ``pairs``.

    Cells are scaled by the log of their odds between the classes. The loss is the weighted log loss, an absolute and a squared penalty on the
    weights, and ``fairness`` times the mean squared change of the logit between the two sides of a pair. Solved by accelerated
    proximal gradient steps. With one class only, the model is the constant share of toxic rows, short of 0 and 1.
    """
    total = weight.sum()
    share = (weight[toxic > 0].sum() + SMOOTHING) / (total + 2 * SMOOTHING) if len(rows) else 0.0
    if not len(rows) or toxic.min() == toxic.max():
        return Model(np.zeros(CELLS), float(np.log(share / (1 - share))) if len(rows) else -500.0)
    count = [np.zeros(CELLS), np.zeros(CELLS)]
    for r, t in zip(rows, toxic):
        count[int(t)][r] += 1
    seen = count[0] + count[1] > 1
    odds = [(c + SMOOTHING) / ((toxic == t).sum() + 2 * SMOOTHING) for t, c in enumerate(count)]
    used = np.flatnonzero(seen)
    place = np.full(CELLS, -1)
    place[used] = np.arange(len(used))
    scale = np.log(odds[1] / odds[0])[used]
    x, left, right = _Rows(rows, place), _Rows([a for a, _ in pairs], place), _Rows([b for _, b in pairs], place)
    part = weight / total

    def gradient(v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        u = scale * v
        p = 1 / (1 + np.exp(-np.clip(b + x.dot(u), -500, 500)))
        g = part * (p - toxic)
        out = x.back(g, len(used))
        if len(pairs) and fairness:
            change = (left.dot(u) - right.dot(u)) * (2 * fairness / len(pairs))
            out += left.back(change, len(used)) - right.back(change, len(used))
        return scale * out + L2 * v, float(g.sum())

    # The steepest curvature, by a few power steps, bounds the step length.
    probe = np.abs(scale) / np.linalg.norm(scale)
    steep = 1.0
    for _ in range(12):
        d = x.back(part * 0.25 * x.dot(scale * probe), len(used))
        if len(pairs) and fairness:
            change = (left.dot(scale * probe) - right.dot(scale * probe)) * (2 * fairness / len(pairs))
            d += left.back(change, len(used)) - right.back(change, len(used))
        d = scale * d
        steep = float(np.linalg.norm(d))
        if steep == 0:
            break
        probe = d / steep
    step = 1 / (1.2 * steep + L2 + 0.25)
    v, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    ahead, ahead_b, t = v, b, 1.0
    for _ in range(STEPS):
        g, gb = gradient(ahead, ahead_b)
        new = ahead - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = ahead_b - step * gb
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_next * (new - v), new_b + (t - 1) / t_next * (new_b - b)
        v, b, t = new, new_b, t_next
    weights = np.zeros(CELLS)
    weights[used] = scale * v
    return Model(weights.astype(np.float32), b)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for documents that learning leaves out: the CRC of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _examples(terms: Sequence[Sequence[str]]):
    """The cells of each sampled document, and of the two sides of its swapped sentences."""
    pack = lambda texts: [cells.astype("<i4").tobytes() for cells in _split(texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [list(swapped(t, terms)) for t in texts]
            sides = [pa.array([pack([p[side] for p in some]) for some in pairs], pa.list_(pa.binary())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(pack(texts), pa.binary()), *sides],
                ["doc_id", "toxic", "cells", "first", "second"],
            )

    return run


def _split(texts: Sequence[str]) -> list[np.ndarray]:
    of, cells = cells_of(texts)
    return np.split(cells, np.searchsorted(of, np.arange(1, len(texts)))) if len(texts) else []


def learn(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> Model:
    """The classifier of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, without the documents held out.

    About ``SAMPLE_PER_CLASS`` documents of each class, chosen by a hash among all that can be used (a text of at most ``LONGEST`` characters,
    a label of 0 or 1), are weighted by the size of their class. Only their cells reach the driver. A doc_id counts once per class
    however often it occurs, with one of its texts; conflicting labels count as one example of each class.
    """
    spark = docs.sparkSession
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text")
    marked = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    marked = stage(usable.select("doc_id").distinct().join(marked, "doc_id"), "toxic-labels")
    totals = dict(marked.groupBy("toxic").count().collect())
    if not totals:
        return fit([], np.empty(0, int), np.empty(0), [])
    sample = None
    for toxic in sorted(totals):
        some = hash_sample(marked.where(F.col("toxic") == toxic), SAMPLE_PER_CLASS, "doc_id")
        sample = some if sample is None else sample.unionByName(some)
    # The sample has some thousands of short rows whatever the table, so texts need no shuffle to find it.
    found = usable.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = found.mapInArrow(_examples(terms), f"doc_id {kind}, toxic int, cells binary, first array<binary>, second array<binary>")
    rows = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("cells", "first", "second")).alias("x")).orderBy("doc_id", "toxic").collect()
    read = lambda data: np.frombuffer(data, "<i4").astype(np.int64)
    toxic = np.array([r["toxic"] for r in rows])
    weight = np.array([totals[int(t)] for t in toxic]) / np.maximum(np.bincount(toxic, minlength=2), 1)[toxic]
    pairs = [(read(a), read(b)) for r in rows for a, b in zip(r["x"]["first"], r["x"]["second"])]
    return fit([read(r["x"]["cells"]) for r in rows], toxic, weight, pairs, fairness)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``: how likely the text's label is toxic (0 to 1), and whether that is 0.5 or more.

    A text counts as the set of its words and word beginnings, lower-cased and hashed; the score is a logistic function of the sum of their
    weights, from the whole text and from nothing else. The weights are fitted on a bounded sample of labelled rows
    (``learn``). Sentences of these that name a group of people (``terms``) are written again with another group or none, and a change
    of score is penalised, so the naming itself gets no weight, whatever the labels of documents that do it.

    Texts without a word (null, empty) get the score of the constant alone. Very long texts are read in pieces between words, which changes nothing. With no
    label to learn from every score is 0; with labels of one class only, every score is near it. Repeated rows are all returned; rows with a null doc_id are not held out
    and have no label. Labels other than 0 and 1 are ignored. An empty table gives an empty result. Input columns named like a new one, in any case, are replaced.
    """
    model = learn(docs, labels, terms, fairness)
    packed, kept = carried(docs, ("held_out", "score", "predicted"))
    row = packed.schema["__row"].dataType.simpleString()
    done = packed.mapInArrow(_scored(model), f"__row {row}, text string, score double")
    done = done.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return done.withColumn("held_out", held_out())
