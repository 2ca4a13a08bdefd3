"""State and output of a micro-batch job as tables in the shared folder.

Batch n reads the state of batch n-1 and writes state n and output n. A batch that is run again
after a failure overwrites its own files only, so results are the same as without the failure.

A state table is whole in every batch, so only the last two are kept. An output table grows: every so many batches the
single folders become one run, and runs of one size become a larger one. A manifest names the runs that count. It appears
by one rename after its runs are written, so readers see the old files or the new ones and never half of either.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


class BatchTables:
    """Named tables of one streaming job, one folder per batch, compacted as they grow.

    ``every`` is how many batches make a run, ``fan`` how many runs of a level make one of the next. A table then has at most
    ``2 every`` batch folders and ``fan`` runs per level, and each row is rewritten once per level.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 32, fan: int = 8):
        self.spark, self.root, self.every, self.fan = spark, root, every, fan

    def path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch:09d}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self, *folders: str) -> None:
        fs, path = self._fs()
        for folder in folders:
            fs.delete(path(folder), True)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """A batch's output, kept for good."""
        if batch and batch % self.every == 0:
            self._compact(name, batch, df.schema)
        df.write.mode("overwrite").parquet(self.path(name, batch))
        return self.spark.read.schema(df.schema).parquet(self.path(name, batch))

    def write_state(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """The state after a batch. That of the batch before stays, in case this one runs again; older ones go."""
        df.write.mode("overwrite").parquet(self.path(name, batch))
        if batch > 1:
            self._remove(self.path(name, batch - 2))
        return self.spark.read.schema(df.schema).parquet(self.path(name, batch))

    def drop(self, name: str, batch: int) -> None:
        """Remove a table of this batch that nothing reads any more."""
        self._remove(self.path(name, batch))

    def read(self, name: str, batch: int, schema: str) -> DataFrame:
        """State after ``batch``; empty before the first one."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name, batch))

    # --- runs ----------------------------------------------------------------------------

    def _manifest(self, name: str) -> dict:
        """The newest manifest: ``upto`` (the last batch in its runs), the runs, and folders that they replaced."""
        folder = f"{self.root}/{name}/_manifest"
        known = [n for n in self._names(folder) if n.endswith(".json")]
        if not known:
            return {"upto": -1, "runs": [], "replaced": []}
        rows = self.spark.read.option("wholetext", True).text(f"{folder}/{known[-1]}").collect()
        return json.loads(rows[0][0])

    def _loose(self, name: str, after: int, upto: int | None) -> list[int]:
        """Finished batch folders later than ``after``."""
        fs, path = self._fs()
        found = [int(n[6:]) for n in self._names(f"{self.root}/{name}") if n.startswith("batch=")]
        found = [b for b in found if b > after and (upto is None or b <= upto)]
        return [b for b in found if fs.exists(path(f"{self.path(name, b)}/_SUCCESS"))]

    def _compact(self, name: str, batch: int, schema: StructType) -> None:
        """Turn the folders of finished batches into a run. Every batch before ``batch`` is finished, so a repeated call finds nothing to do."""
        old = self._manifest(name)
        loose = self._loose(name, old["upto"], batch - 1)
        if not loose:
            return
        runs, replaced = list(old["runs"]), [self.path(name, b) for b in loose]

        def run_of(df: DataFrame, level: int) -> dict:
            folder = f"run-{batch:09d}-{level}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{name}/{folder}")
            return {"folder": folder, "level": level}

        single = self.spark.read.schema(_with_batch(schema)).option("basePath", f"{self.root}/{name}")
        runs.append(run_of(single.parquet(*replaced), 0))
        level = 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            full = [r for r in runs if r["level"] == level]
            folders = [f"{self.root}/{name}/{r['folder']}" for r in full]
            runs = [r for r in runs if r["level"] != level]
            runs.append(run_of(self.spark.read.schema(_with_batch(schema)).parquet(*folders), level + 1))
            replaced += folders
            level += 1
        self._publish(name, {"upto": batch - 1, "runs": runs, "replaced": replaced})
        # What the manifest before this one replaced has no reader any more.
        self._remove(*old["replaced"])

    def _publish(self, name: str, manifest: dict) -> None:
        fs, path = self._fs()
        folder = f"{self.root}/{name}/_manifest"
        earlier = self._names(folder)
        new = path(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = path(f"{folder}/{manifest['upto']:09d}.json")
        if fs.exists(final):
            fs.delete(final, False)
        fs.rename(new, final)
        self._remove(*(f"{folder}/{n}" for n in earlier[:-1]))

    def all_batches(self, name: str, schema: str, upto: int | None = None, keep_batch: bool = False) -> DataFrame:
        """Output of every finished batch so far, or up to batch ``upto``; ``keep_batch`` adds the batch number of each row."""
        manifest, root = self._manifest(name), f"{self.root}/{name}"
        read = self.spark.read.schema(schema + ", batch INT")
        parts = []
        if manifest["runs"]:
            parts.append(read.parquet(*(f"{root}/{r['folder']}" for r in manifest["runs"])))
        loose = self._loose(name, manifest["upto"], upto)
        if loose:
            parts.append(self.spark.read.schema(schema + ", batch INT").option("basePath", root).parquet(*(self.path(name, b) for b in loose)))
        rows = self.spark.createDataFrame([], schema + ", batch INT") if not parts else parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
        return rows if keep_batch else rows.drop("batch")


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("batch", IntegerType())
