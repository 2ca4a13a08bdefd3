"""Substring dedup: windows travel to their minimiser's bucket inside super-k-mers and are counted there by sorting."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.common import binaries, partitions_for, shuffle_partitions, stage

WINDOW = 13
#: Words of a minimiser.
GRAM = 3
#: Text that is split at once; larger documents are taken alone.
CHUNK = 2_000_000
#: Bytes of super-k-mers, unpacked, in one bucket, and the parts of a bucket that are sorted one after the other.
BUCKET_BYTES = 24 << 20
PARTS = 16
#: Bytes of super-k-mers for each byte of text: six windows share a minimiser on average.
GROWTH = 3.0
#: A minimiser this frequent (one of so many word positions) is chosen only where a window holds nothing rarer.
FREQUENT = 1000

BASE = np.uint64(0x9E3779B97F4A7C15)
HIGH = np.uint64(1 << 63)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    powers = []
    for base in (BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p, dtype=np.uint64))
    return powers[0], powers[1]


class Words:
    """The words of some texts in one buffer, each after one blank, with hashes of any span of words."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        keep = ~blank
        keep[first - 1] = True
        self.bytes = np.where(blank, np.uint8(32), raw)[keep]
        lengths = last - first
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths
        begin = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])
        self.text_of = (np.searchsorted(begin, first, "right") - 1).astype(np.int32)
        powers, self._inverse = _powers(1 << max(CHUNK.bit_length(), len(self.bytes).bit_length()))
        self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
        weighted = self._sums[1:]
        weighted += self.bytes
        weighted += np.uint64(1)
        weighted *= powers[: len(self.bytes)]
        np.cumsum(weighted, out=weighted)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from word ``first`` to word ``last``."""
        a, b = self.starts[first], self.ends[last]
        h = (self._sums[b] - self._sums[a]) * self._inverse[a]
        return mixed_bits(h ^ ((b - a).astype(np.uint64) << np.uint64(40)))


def _grams(words: Words) -> np.ndarray:
    n = len(words.starts) - GRAM + 1
    at = np.arange(max(n, 0))
    return words.spans(at, at + GRAM - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
            if size + len(text) > CHUNK and texts:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text)
        if texts:
            yield np.array(ids, np.int64), texts


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word n-grams that are frequent in a chunk with their counts, and under key -1 the chunk's word positions and bytes."""
    for _, texts in _chunks(batches):
        grams = _grams(Words(texts))
        values, counts = np.unique(grams, return_counts=True)
        some = counts * 2 * FREQUENT > len(grams)
        keys = [np.array([-1]), np.array([-2]), (values[some] >> np.uint64(1)).astype(np.int64)]
        counts = [np.array([len(grams)]), np.array([sum(map(len, texts))]), counts[some]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], ["gram", "n"])


def _super_kmers(words: Words, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each super-k-mer and its bucket hash.

    Consecutive windows of a text with the same minimiser form one; a window made of frequent n-grams only stands alone
    and goes by its own hash, so no frequent n-gram gathers the windows around it in one bucket.
    """
    n = len(words.starts) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64)
    grams = _grams(words) >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        grams = np.where(common[place] == grams, grams | HIGH, grams)
    least = _sliding_least(grams, WINDOW - GRAM + 1)
    at = np.arange(n)
    usable = words.text_of[:n] == words.text_of[WINDOW - 1 :]
    alone = (least & HIGH) > 0
    least = np.where(alone, words.spans(at, at + WINDOW - 1), least)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (words.text_of[1:n] != words.text_of[: n - 1]) | alone[1:] | ~usable[:-1]
    first = at[new & usable]
    # A super-k-mer ends before the next one starts or where its text runs out.
    breaks = np.flatnonzero(np.append(new | ~usable, True))
    last = breaks[np.searchsorted(breaks, first, "right")] - 1
    return first, last, mixed_bits(least[first])


def _packed(buckets: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for ids, texts in _chunks(batches):
            words = Words(texts)
            tags = np.array([crc32(t) for t in texts], np.uint32)
            begin = np.searchsorted(words.text_of, np.arange(len(texts)))
            first, last, key = _super_kmers(words, common)
            end = last + WINDOW - 1
            text = words.text_of[first]
            doc = ids[text]
            whole = words.bytes.tobytes()
            a, b = words.starts[first], words.ends[end]
            # Of equal super-k-mers only those of the smallest document go on; the others are answered here.
            same = words.spans(first, end)
            order = np.lexsort((doc, same))
            head = np.ones(len(order), bool)
            head[1:] = same[order][1:] != same[order][:-1]
            heads = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            answered = np.zeros(len(order), bool)
            later = np.flatnonzero(doc[order] > doc[heads])
            for copy, one in zip(order[later].tolist(), heads[later].tolist()):
                answered[copy] = whole[a[copy] : b[copy]] == whole[a[one] : b[one]]
            start = (first - begin[text]).astype(np.int32)
            stop = (end + 1 - begin[text]).astype(np.int32)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            part = (key // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
            rows_bucket, rows_data = [], []

            def put(number: int, which: np.ndarray, sizes: np.ndarray, tail: np.ndarray | bytes) -> None:
                """A compressed row: the documents, then of each run its document (as steps) and first word."""
                held, place = np.unique(text[which], return_inverse=True)
                head_ = struct.pack("<II", len(held), len(which)) + sizes.astype(np.int32).tobytes()
                body = ids[held].tobytes() + tags[held].tobytes() + np.diff(place, prepend=0).astype(np.int32).tobytes()
                rows_bucket.append(number)
                rows_data.append(pack(head_ + body + start[which].tobytes() + bytes(tail)))

            none = np.zeros(PARTS, np.int64)
            if answered.any():
                which = np.flatnonzero(answered)
                put(int(crc32(ids.tobytes()) % buckets), which, none, stop[which].tobytes())
            open_ = np.flatnonzero(~answered)
            open_ = open_[np.lexsort((open_, part[open_], bucket[open_]))]
            cuts = np.flatnonzero(np.diff(bucket[open_])) + 1
            for which in np.split(open_, cuts) if len(open_) else ():
                tail = b"\n".join([whole[i:j] for i, j in zip(a[which].tolist(), b[which].tolist())])
                put(int(bucket[which[0]]), which, np.bincount(part[which], minlength=PARTS), tail)
            yield pa.RecordBatch.from_arrays([pa.array(rows_bucket, pa.int64()), pa.array(rows_data, pa.binary())], ["bucket", "data"])

    return run


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Runs per part (all zero for runs answered before), and of each run doc_id, tag and first word; then the rest."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, runs = struct.unpack_from("<II", raw)
    at, out = 8, []
    for kind, n in ((np.int32, PARTS), (np.int64, docs), (np.uint32, docs), (np.int32, runs), (np.int32, runs)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    sizes, ids, tags, steps, start = out
    place = np.cumsum(steps)
    return sizes, ids[place], tags[place], start, raw[at:]


def later_windows(doc: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Windows inside the runs (one text each) that a smaller document holds too: their first word and that they do."""
    n = len(words.starts) - WINDOW + 1
    at = np.flatnonzero(words.text_of[: max(n, 0)] == words.text_of[WINDOW - 1 :]) if n > 0 else np.empty(0, np.int64)
    hashes, docs = words.spans(at, at + WINDOW - 1), doc[words.text_of[at]]
    order = np.lexsort((docs, hashes))
    sorted_ = hashes[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    heads = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.zeros(len(at), bool)
    some = np.flatnonzero(docs[order] > docs[heads])
    whole = words.bytes.tobytes()
    a, b = words.starts[at], words.ends[at + WINDOW - 1]
    unequal = []
    for one, first in zip(order[some].tolist(), heads[some].tolist()):
        if whole[a[one] : b[one]] == whole[a[first] : b[first]]:
            later[one] = True
        else:
            unequal.append(hashes[one])
    for h in set(unequal):  # different windows of one hash: told apart by their words
        least: dict[bytes, int] = {}
        members = np.flatnonzero(hashes == h)
        for i in members:
            text = whole[a[i] : b[i]]
            least[text] = min(least.get(text, int(docs[i])), int(docs[i]))
        for i in members:
            later[i] = docs[i] > least[whole[a[i] : b[i]]]
    return at, later


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges that documents lose, bucket by bucket."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(number, []).append(data)
    for number in sorted(held):
        runs: list[list[tuple]] = [[] for _ in range(PARTS)]
        for data in held.pop(number):
            sizes, doc, tag, start, rest = _unpacked(data)
            if not sizes.any():
                yield _ranges(doc, tag, start, np.frombuffer(rest, np.int32))
                continue
            texts, ends = rest.split(b"\n"), np.cumsum(sizes)
            for part, (a, b) in enumerate(zip(ends - sizes, ends)):
                runs[part].append((doc[a:b], tag[a:b], start[a:b], texts[a:b]))
        for part in range(PARTS):
            if runs[part]:
                doc, tag, start = (np.concatenate(x) for x in list(zip(*runs[part]))[:3])
                words = Words([t for r in runs[part] for t in r[3]])
                runs[part] = []
                at, later = later_windows(doc, words)
                run = words.text_of[at]
                first_word = np.searchsorted(words.text_of, np.arange(len(doc)))
                joined = later[1:] & later[:-1] & (run[1:] == run[:-1])
                begin, finish = later.copy(), later.copy()
                begin[1:] &= ~joined
                finish[:-1] &= ~joined
                own, at_word = run[begin], at - first_word[run] + start[run]
                yield _ranges(doc[own], tag[own], at_word[begin], at_word[finish] + WINDOW)


def _ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc), pa.array(tag.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "stop"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, removed, digests = [], [], [], []
        for text, lost in zip(binaries(batch.column("text")), batch.column("__lost").to_pylist()):
            words = (text or b"").split()
            sizes.append(len(words))
            if lost:
                tag = crc32(text or b"")
                gone = np.zeros(len(words) + 1, np.int32)
                for r in lost:
                    if r["tag"] == tag:
                        gone[r["start"]] += 1
                        gone[r["stop"]] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            removed.append(sizes[-1] - len(words))
            texts.append(b" ".join(words))
            digests.append(sha256(texts[-1]).hexdigest())
        arrays = [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, start, stop)``: word ranges covered by windows that a smaller doc_id holds too; tag is the text's CRC."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(_frequent, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = stage(found, "frequent-grams")
    totals = {r["gram"]: r["n"] for r in found.where("gram < 0").collect()}
    positions, size = totals.get(-1, 0), totals.get(-2, 0)
    # At most FREQUENT n-grams can be this frequent.
    common = [r["gram"] for r in found.where((F.col("gram") >= 0) & (F.col("n") * FREQUENT > positions)).select("gram").collect()]
    buckets = partitions_for(GROWTH * size, BUCKET_BYTES, shuffle_partitions(spark))
    packed = texts.mapInArrow(_packed(buckets, np.sort(np.array(common, np.uint64))), "bucket long, data binary")
    return packed.repartition(buckets, "bucket").mapInArrow(_counted, "doc_id long, tag long, start int, stop int")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, kept_sha256)``: texts without passages that a smaller doc_id holds.

    Words are runs of non-blank characters, unchanged. A window is 13 consecutive words of one document; a word goes if a
    window covering it starts in a document with a smaller doc_id too, judged on the input. Windows repeated inside one
    document alone stay. Kept words are joined by one space.

    The text is split into super-k-mers, maximal runs of windows with the same minimiser (the least hash of their 3-word
    n-grams), which travel as strings to the minimiser's bucket; there windows are sorted by hash and compared word for
    word. Equal super-k-mers of one chunk of text are answered on the spot, so a passage in a third of all
    documents is a row per chunk in its bucket.

    A null text has no words. Rows with a null doc_id take no part and keep all words. Rows that share a doc_id are one
    document; their windows are never smaller than one another. An empty table gives an empty result. Other columns are ignored.
    """
    gone = F.collect_list(F.struct("tag", "start", "stop")).alias("__lost")
    lost = repeated_ranges(docs).groupBy(F.col("doc_id").alias("__id")).agg(gone)
    joined = docs.select("doc_id", "text").join(lost, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_words long, n_removed long, kept_sha256 string")
