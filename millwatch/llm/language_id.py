"""Language ID: expectation-maximisation of each document's language mixture from n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.common import binaries, carried, shuffle_partitions

UNKNOWN = "und"
#: Character trigrams fall in so many hashed cells; a language model is one row of them.
CELLS = 1 << 16
#: Cells that travel as one row while counts are summed.
SLICE = 1 << 12
SMOOTHING = 0.5
STEPS = 12
#: Texts are taken together up to so many characters, a longer one alone: a character costs some 100 bytes while its text is read.
CHARS_AT_ONCE = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased words with a boundary at both ends: cells, start of each word, words per text."""
    codes = np.frombuffer(("\0" + "\0".join(t.lower() for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the boundary before a word
    text_of = np.cumsum(np.concatenate([[0], [len(t.lower()) + 1 for t in texts]]))
    begins = np.flatnonzero(~letter[:-1] & letter[1:]) + 1
    words = np.bincount(np.searchsorted(text_of, begins, "right") - 1, minlength=len(texts))
    packed = np.where(letter, codes, 0)[keep].astype(np.uint64)
    packed = np.append(packed, np.uint64(0))
    a, b, c = packed[:-2], packed[1:-1], packed[2:]
    middle = b != 0
    h = ((a * np.uint64(0x1F35B) + b) * np.uint64(0x2C9277B5) + c) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.flatnonzero((packed[:-2] == 0)[middle])
    return (h >> np.uint64(48)).astype(np.int64)[middle], starts, words


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of the texts that are not empty, in groups of bounded size."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if held and size + len(t) > CHARS_AT_ONCE:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(t)
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a whole task, in slices."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            held = counts.setdefault(lang, np.zeros(CELLS, np.int64))
            for which in _groups(texts):
                cells, _, _ = _trigrams([texts[i] for i in which])
                held += np.bincount(cells, minlength=CELLS)
    yield _slices([(lang, at, c[at : at + SLICE]) for lang, c in counts.items() for at in range(0, CELLS, SLICE)])


def _slices(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "at", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["counts"], np.int64)
            key = (row["lang"], row["at"])
            sums[key] = sums[key] + part if key in sums else part
    yield _slices([(*k, v) for k, v in sums.items()])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability of each cell under each of them, from all of ``docs(lang, text)``.

    Tasks count whole partitions and send a row per language and slice, so counting does not depend on how frequent
    a language is. The model is half a megabyte per language; languages are labels, some hundreds at most.
    """
    parts = docs.select("lang", "text").mapInArrow(_counted, "lang string, at int, counts binary")
    rows = parts.repartition(shuffle_partitions(docs.sparkSession), "lang", "at").mapInArrow(_summed, "lang string, at int, counts binary").collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), CELLS))
    for r in rows:
        counts[langs.index(r["lang"]), r["at"] : r["at"] + SLICE] = np.frombuffer(bytes(r["counts"]), np.int64)
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CELLS))
    return langs, np.ascontiguousarray(logs.T.astype(np.float32))


def _fit(relative: np.ndarray, starts: np.ndarray, of: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    """EM steps for the language proportions of each document; a zero proportion stays zero."""
    for _ in range(steps):
        weight = relative * share[of]
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.add.reduceat(weight, starts, axis=0) / n[:, None]
    return share


def mixtures(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's selected language set, and the size of the set.

    ``words`` has the log-likelihood of each word under each language, ``n`` the words of each document (one at least).
    Languages are ranked by the proportions of the full mixture. Sets of the 1, 2, ... first are fitted again, and the set with the
    highest log-likelihood less half the log of the word count for each further language is selected. A document is
    done once no larger set can win: no mixture's log-likelihood exceeds that of the full one by more than n times the log of its steepest slope.
    """
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    of = np.repeat(np.arange(len(n)), n)
    relative = np.exp(np.maximum(words - words.max(axis=1, keepdims=True), -80)).astype(np.float64)
    full = _fit(relative, starts, of, n, np.full((len(n), words.shape[1]), 1 / words.shape[1]), STEPS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    mixed = (relative * full[of]).sum(axis=1)
    slope = np.add.reduceat(relative / mixed[:, None], starts, axis=0).max(axis=1) / n
    most = np.add.reduceat(np.log(mixed), starts) + n * np.log(slope)
    best, score, size = np.zeros_like(full), np.full(len(n), -np.inf), np.ones(len(n), int)
    going = np.arange(len(n))
    for k in range(1, words.shape[1] + 1):
        share = np.where(rank < k, np.maximum(full, 1e-6), 0.0)
        share /= share.sum(axis=1, keepdims=True)
        if k > 1:
            share = _fit(relative, starts, of, n, share, STEPS // 2)
        fit = np.add.reduceat(np.log((relative * share[of]).sum(axis=1)), starts) - (k - 1) * 0.5 * np.log(n)
        more = fit > score[going]
        best[going[more]], size[going[more]], score[going[more]] = share[more], k, fit[more]
        open_ = most - k * 0.5 * np.log(n) > score[going]
        if not open_.any():
            break
        if not open_.all():
            relative = relative[open_[of]]
            going, n, full, rank, most = going[open_], n[open_], full[open_], rank[open_], most[open_]
            starts, of = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)
    return best, size


def _predicted(langs: list[str], logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for which in _groups(texts) if langs else ():
                cells, starts, n = _trigrams([texts[i] for i in which])
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                share, _ = mixtures(np.add.reduceat(logs[cells], starts, axis=0), n[some])
                top = share.argmax(axis=1)
                for row, doc in enumerate(some):
                    i = which[doc]
                    best[i] = langs[top[row]]
                    score[i] = min(1.0, share[row, top[row]])
                    sets[i] = [langs[l] for l in np.argsort(-share[row], kind="stable") if share[row, l] > 0]
            kept = batch.select([c for c in batch.schema.names if c != "text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, batch.column("text"), pa.array(best, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))],
                [*kept.schema.names, "text", "lang_pred", "score", "languages"],
            )

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for documents that training leaves out: the CRC of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score, languages``, learned from its own labelled documents.

    Each language's character trigrams are counted over all documents with a text, a lang and no held-out doc_id. A
    word's likelihood under a language is the product over its trigrams. EM gives every document's mixture;
    penalised likelihood selects its language set (``languages``, most first). ``lang_pred`` is the first and ``score`` its proportion. Only
    the text is used for a prediction, and the whole of it.

    A text that is null or has no letter, and any text if nothing can be learned, gets ``und``, score 0 and an empty set.
    Rows with a null doc_id count as not held out. Repeated rows are all returned, and are counted as often as they occur. An empty
    table gives an empty result. Input columns named like a new one, in any case, are replaced.
    Very long texts are read whole; one of any length is one row of its task.
    """
    new = ("held_out", "lang_pred", "score", "languages")
    langs, logs = learn(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    packed, columns = carried(docs, new)
    row = packed.schema["__row"].dataType.simpleString()
    done = packed.mapInArrow(_predicted(langs, logs), f"__row {row}, text string, lang_pred string, score double, languages array<string>")
    done = done.select(*columns, "lang_pred", "score", "languages")
    return done.withColumn("held_out", held_out())


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents in which a language was found, ``lang`` set to it; the columns of ``docs``, whatever their names."""
    packed, columns = carried(docs, keys=("doc_id", "text", "lang"))
    found = identify(packed).where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred"))
    return found.select(*columns)
