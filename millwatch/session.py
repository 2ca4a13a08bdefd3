"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Ticks and minutes are counted from the UTC epoch.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing the message.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # HotSpot never compiles a method above 8000 bytecodes. Rows with 48 measures exceed that in one
    # generated method, so such stages fall back to split, compiled projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_STAGED: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}
_LOCAL_ROOT: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on; safe to call again."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "millwatch", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    A machine-local folder is used only where the session names none and runs in one process, as in tests.
    On a cluster, executors would each write to their own disks, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="millwatch-")
        root = _LOCAL_ROOT[app]
    path = os.path.join(root, "millwatch", f"{name}-{uuid.uuid4().hex}")
    _STAGED.setdefault(app, []).append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh catalog name for a table that lives below ``scratch_path`` and leaves the catalog with it."""
    table = f"{name}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this session has staged. Results that still read it must have been written before."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        folder = hadoop(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later passes read one expensive result. The table survives lost
    executors and is read with column pruning, unlike a cached RDD.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
