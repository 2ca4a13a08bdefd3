"""Line dedup: levelled sorted runs of line hashes that each new batch merge-anti-joins."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from millwatch.llm.common import binaries, carried, shuffle_partitions, stage
from millwatch.session import scratch_path, scratch_table

#: Shorter keys (in code points) never count as repeated.
LEAST_KEY = 10
BLANKS = b" \t\n\x0b\x0c\r"

LINES = "h binary, doc_id long, first_here long"


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short."""
    key = line.strip(BLANKS).lower()  # bytes: only A-Z are lowered
    if len(key) < LEAST_KEY or len(key.decode("utf-8", "replace")) < LEAST_KEY:
        return None
    return xxhash.xxh3_128_digest(key)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and distinct key, with the smallest doc_id holding the key within the Arrow batch."""
    for batch in batches:
        first: dict[bytes, int] = {}
        seen: list[tuple[bytes, int]] = []
        for doc, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
            keys = {k for k in map(line_key, text.split(b"\n")) if k}
            for key in keys:
                held = first.get(key)
                if held is None or doc < held:
                    first[key] = doc
                seen.append((key, doc))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in seen], pa.binary()),
                pa.array([d for _, d in seen], pa.int64()),
                pa.array([first[k] for k, _ in seen], pa.int64()),
            ],
            ["h", "doc_id", "first_here"],
        )


class LineRuns:
    """Sorted runs of line hashes in levels: ``fanout`` runs of a level are merged into one of the next.

    A run is an external table in the shared folder, bucketed and sorted by hash, so a batch that is laid out once
    merges with every run without moving any of them. Hashes of different runs are disjoint.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.folder = scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys(h, ...)`` whose hash is in no run."""
        for run in self.runs:
            keys = keys.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti")
        return keys

    def _write(self, rows: DataFrame, level: int) -> str:
        name = scratch_table(self.spark, f"line_run_{level}")
        writer = rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """Add the unseen rows of ``keys(h, first)`` as a run, compact full levels, and return the run."""
        name = self._write(self.unseen(keys), 0)
        self.levels[0].append(name)
        added = self.spark.table(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.spark.table(self.levels[level][0])
            for run in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(run))
            merged = merged.repartition(self.buckets, "h").sortWithinPartitions("h")
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged, level + 1))
            # The old runs' files stay until the caller's results, which may still read them, are done.
            self.levels[level] = []
            level += 1
        return added


def repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``(doc_id, h)``: the key hashes whose lines a document loses.

    Documents come in ``batches`` ranges of doc_id, smallest first. A key of a batch that is in no earlier run is new and
    belongs to the smallest doc_id of the batch holding it; all other holders lose it. Text is read once. Within an Arrow batch
    only the smallest holder of a key goes on to the shuffle, so a line that a third of all documents share is a row
    per Arrow batch there, not a row per document.
    """
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    lines = ids.mapInArrow(_lines_of, LINES)
    batch = sum((F.when(F.col("doc_id") > cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0))
    path = scratch_path(spark, "lines")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    staged = spark.read.schema(f"{LINES}, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    lost = staged.where("first_here < doc_id").select("doc_id", "h")
    for number in range(len(set(cuts)) + 1):
        held = staged.where(f"batch = {number} and first_here = doc_id").select("h", "doc_id")
        added = runs.add(held.groupBy("h").agg(F.min("doc_id").alias("first")))
        held = held.join(added.hint("merge"), "h", "left")
        lost = lost.unionByName(held.where("first is null or first < doc_id").select("doc_id", "h"))
    return lost


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped, digests = [], [], [], []
        for text, lost in zip(binaries(batch.column("text")), batch.column("__lost").to_pylist()):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if lost:
                gone = set(lost)
                lines = [x for x in lines if line_key(x) not in gone]
                text = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            texts.append(text)
            digests.append(sha256(text or b"").hexdigest())
        kept = batch.select([n for n in batch.schema.names if n not in ("text", "__lost")])
        columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(kept.columns + columns, kept.schema.names + ["text", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` without repeated lines: all its columns with ``text`` rebuilt, and ``n_lines, n_dropped, kept_sha256``.

    Lines are split at line feeds. A key is the line without white space at both ends and with A-Z lowered; a key of at
    least ten code points that two or more documents hold loses all its lines except in the smallest doc_id holding it.
    Lines repeated inside that document stay. Keys are told apart by 128-bit hashes.

    A null text counts as one empty line and stays null. Rows with a null doc_id take no part and stay as they are. Rows
    that share a doc_id are one document: they lose the same keys. A document all of whose lines go keeps the
    empty text. An empty table gives an empty result. Input columns named like a new one, in any case, are
    replaced. A text of any length is one row of its task.
    """
    packed, columns = carried(docs, ("n_lines", "n_dropped", "kept_sha256"), ("doc_id", "text"))
    lost = repeated_lines(docs, batches, fanout).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("h").alias("__lost"))
    joined = packed.join(stage(lost, "lost-lines"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    row = packed.schema["__row"].dataType.simpleString()
    schema = f"__row {row}, doc_id {dict(docs.dtypes)['doc_id']}, text string, n_lines long, n_dropped long, kept_sha256 string"
    done = joined.mapInArrow(_rebuilt, schema)
    return done.select(*columns, "n_lines", "n_dropped", "kept_sha256")
