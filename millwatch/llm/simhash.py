"""SimHash near-dedup by fuzzy hashing with the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.common import binaries, carried, components, numpy_batches, partitions_for, shuffle_partitions, stage

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits at most; the keys below are built for three.
RADIUS = 3
#: First bit and length of the three segments of a fingerprint; each is a word of the 23-bit code, zero-padded.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of (key, fingerprint) that one task of the key shuffle gets.
ROWS_PER_TASK = 1_000_000
#: Fingerprint pairs compared at once.
BLOCK = 2048


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash over 3-word shingles (repeats included); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - SHINGLE]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in binaries(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words, and the error pattern of each of the 2,048 syndromes.

    The code is perfect: the 2,048 patterns of at most three errors have distinct syndromes, so every 23-bit word
    is within three bits of exactly one codeword.
    """
    generator = 0b101011100011  # fixed value: a generator polynomial of the (23, 12) Golay code
    units = []
    for bit in range(23):
        word = 1 << bit
        for top in range(22, 10, -1):
            if word >> top & 1:
                word ^= generator << (top - 11)
        units.append(word)
    errors = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= units[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return np.array(units, np.uint32), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    units, errors = _decoder()
    syndrome = np.zeros(words.shape, np.uint32)
    for bit in range(23):
        syndrome ^= np.where(words >> np.uint32(bit) & np.uint32(1), units[bit], np.uint32(0))
    return (words ^ errors[syndrome]) >> np.uint32(11)


def nearby_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and of its neighbours at one bit: an array of six columns and its mask.

    A word within two bits of its codeword has one index, any other has at most six.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, order, 1).astype(np.int64), np.take_along_axis(new, order, 1)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints as (key, row of ``prints``, stored): two within three bits share a key, stored on one side.

    Stored keys use a segment's own codeword index; probing keys use those of its one-bit neighbourhood, which hold the
    stored index of every segment at one bit or less. Three errors over three segments leave either one error or none in
    each segment, or one segment with none and another with at most one. So the keys are
    * both indices of the first two segments and one half of the third, exactly (one half is free of errors), and
    * one segment exactly and the index of another (six ordered pairs).
    Each key holds 33 to 35 bits of the fingerprint, so chance collisions stay rare for billions of fingerprints.
    """
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.uint32) for s, n in SEGMENTS]
    own = [codeword_index(p).astype(np.int64) for p in parts]
    near = [nearby_indices(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows = np.arange(len(prints))
    keys, owners, stored = [], [], []

    def put(kind: int, key: np.ndarray, owner: np.ndarray, is_stored: bool) -> None:
        keys.append(key | (kind << 40))
        owners.append(owner)
        stored.append(np.full(len(key), is_stored))

    third = parts[2].astype(np.int64)
    for kind, half in enumerate((third & 0x7FF, third >> 11)):
        put(kind, own[0] | own[1] << 12 | half << 24, rows, True)
        both = near[0][1][:, :, None] & near[1][1][:, None, :]
        row, i, j = np.nonzero(both)
        put(kind, near[0][0][row, i] | near[1][0][row, j] << 12 | half[row] << 24, row, False)
    for kind, (exact, fuzzy) in enumerate((e, f) for e in range(3) for f in range(3) if e != f):
        whole = parts[exact].astype(np.int64) << 12
        put(kind + 2, own[fuzzy] | whole, rows, True)
        row, i = np.nonzero(near[fuzzy][1])
        put(kind + 2, near[fuzzy][0][row, i] | whole[row], row, False)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(stored)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 4096):
            some = prints[at : at + 4096]
            key, owner, stored = golay_keys(some)
            yield pa.RecordBatch.from_arrays([pa.array(key << 1 | stored), pa.array(some[owner].view(np.int64))], ["key", "fp"])


def _star(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, found by growing each component in turn."""
    links, rest = [], prints
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), BLOCK):
                for to in range(0, len(rest), BLOCK):
                    apart = np.bitwise_count(frontier[at : at + BLOCK, None] ^ rest[None, to : to + BLOCK])
                    near = apart <= RADIUS
                    hit = near.any(axis=0) & ~reached[to : to + BLOCK]
                    which = near.argmax(axis=0)
                    reached[to : to + BLOCK] |= hit
                    for j in np.nonzero(hit)[0]:
                        links.append((int(frontier[at + which[j]]), int(rest[to + j])))
            frontier, rest = rest[reached], rest[~reached]
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each key's fingerprints: a spanning forest, never all pairs."""
    keys, prints = numpy_batches(batches, "key", "fp")
    order = np.lexsort((prints, keys >> 1))
    keys, prints = keys[order], prints[order].view(np.uint64)
    whole = keys >> 1
    starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(whole))
    if len(starts):
        # A key matters if it is stored by some fingerprint and held by another.
        some = np.add.reduceat(keys & 1, starts) > 0
        some &= prints[starts] != prints[ends - 1]
        starts, ends = starts[some], ends[some]
    links: set[tuple[int, int]] = set()
    for a, b in zip(starts, ends):
        links.update(_star(np.unique(prints[a:b])))
    pairs = np.array(sorted(links), dtype=np.uint64).reshape(-1, 2).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """``(a, b)`` over distinct fingerprints ``prints(fp)``: links whose components are those of all pairs within three bits."""
    spark = prints.sparkSession
    keyed = prints.mapInArrow(_keyed, "key long, fp long")
    parts = partitions_for(96 * prints.count(), ROWS_PER_TASK, shuffle_partitions(spark))
    return keyed.repartition(parts, F.shiftright("key", 1)).mapInArrow(_linked, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``: groups of fingerprints linked at three bits.

    A-Z are lowered, words are runs of non-blank characters, shingles are three words; a shorter text is one shingle and
    a text without words, or a null one, has fingerprint zero and links like any other. ``fp`` is the signed form.
    ``component_id`` is the smallest doc_id reachable. Copies share a fingerprint and meet only in a partial aggregation,
    never in a join among themselves.

    Rows with a null doc_id get the group of their text (null if no row of the group has a doc_id). Rows that repeat
    a doc_id are all returned. An empty table gives an empty result. Other columns are ignored.
    """
    prints = stage(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long"), "fingerprints")
    held = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = stage(components(near_links(held.select("fp"))), "fingerprint-roots")
    rooted = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "fingerprint-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "fingerprint-components")
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group of ``simhash_groups``, all columns unchanged.

    Rows with a null doc_id stay only if their group has no other document. Rows that repeat the doc_id that
    stays are one document and stay together.
    """
    groups = simhash_groups(docs)
    packed, columns = carried(docs, keys=("doc_id",))
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return packed.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*columns)
