"""Stored calibration samples: one snapshot per row, partitioned by day and a hash bucket of the equipment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.functions.scalars import parse_duration
from millwatch.operators.snapshots import KEYS
from millwatch.session import stage

# Folders per day, whatever the number of equipments.
BUCKETS = 16
PARTITION = ["day", "bucket"]
STORED_SCHEMA = "equipment_id STRING, episode BIGINT, tick BIGINT, ts TIMESTAMP, values ARRAY<DOUBLE>, day DATE, bucket INT"
SAMPLE_SCHEMA = "timestamp STRING, values MAP<STRING,DOUBLE>"


def sample_time(tick: Column, interval_ms: Column) -> Column:
    return F.timestamp_micros(tick * interval_ms.cast("long") * 1000)


def calibration_samples(tagged: DataFrame, config: DataFrame) -> DataFrame:
    """Snapshots taken while CALIBRATING: ``(equipment_id, episode, tick, ts, values)``."""
    settings = config.select("equipment_id", "resample_interval_ms")
    return (
        tagged.filter(F.col("state") == "CALIBRATING")
        .join(settings, KEYS)
        .select(
            "equipment_id", "episode", "tick", sample_time(F.col("tick"), F.col("resample_interval_ms")).alias("ts"), "values"
        )
    )


def calibration_append(samples: DataFrame, path: str) -> None:
    """Append samples. Rows are grouped by partition first, so a task writes few files; partitions larger than
    Spark's advisory size are split over several tasks and small ones share one.

    An append that is repeated adds rows again; readers take one row per equipment, episode and tick.
    """
    bucket = F.pmod(F.xxhash64("equipment_id"), F.lit(BUCKETS)).cast("int")
    placed = samples.withColumns({"day": F.to_date("ts"), "bucket": bucket})
    placed.hint("rebalance", *PARTITION).write.mode("append").partitionBy(*PARTITION).parquet(path)


def calibration_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored samples, each once."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    return rows.groupBy(*PARTITION, "equipment_id", "episode", "tick", "ts").agg(F.max("values").alias("values"))


def calibration_rewrite(
    spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame], touched: Column | None = None
) -> None:
    """Make files hold only what ``keep`` leaves of the stored samples, e.g. a prune or a clear. ``keep`` decides by key and time.

    First only the keys are read, of the partitions for which ``touched`` (over ``day`` and ``bucket``) holds. Partitions that
    lose all rows are removed without reading their values, those that lose some are written again, each in place of its
    old files, and the others stay as they are. The counts that decide this are one row per partition.
    """
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    keys = stored.select(*PARTITION, "equipment_id", "episode", "tick", "ts")
    if touched is not None:
        keys = keys.filter(touched)
    left = keep(keys).groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("left"))
    counts = keys.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("n")).join(left, PARTITION, "left")
    losing = stage(counts.filter("left IS NULL OR left < n"), "losing-partitions")
    partly = losing.filter("left IS NOT NULL").select(*PARTITION)
    rows = calibration_table(spark, path).join(partly, PARTITION, "left_semi")
    again = stage(keep(rows).select(*stored.columns), "kept-samples").hint("rebalance", *PARTITION)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for r in losing.filter("left IS NULL").toLocalIterator():
        empty = folder(f"{path}/day={r['day']}/bucket={r['bucket']}")
        empty.getFileSystem(spark._jsc.hadoopConfiguration()).delete(empty, True)


def prune_store(spark: SparkSession, path: str, config: DataFrame, now: DataFrame) -> None:
    """``calibration_prune`` on the stored files.

    A sample lies in the folder of its day, so a folder's day bounds its samples. Days after the last day that holds a cutoff keep
    all they have and are not listed for reading; of earlier days the keys are read, and the values only where a cutoff
    falls inside the folder.
    """
    last = _cutoffs(config, now).agg(F.to_date(F.max("cutoff"))).first()[0]
    if last is not None:
        calibration_rewrite(spark, path, lambda stored: calibration_prune(stored, config, now), F.col("day") <= F.lit(last))


def calibration_export(samples: DataFrame, config: DataFrame, path: str) -> None:
    """Samples as JSON lines: ``{"timestamp": …, "values": {tag: number or null}}``."""
    tagged = samples.join(config.select("equipment_id", "tags"), KEYS)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp")
    row = F.struct(stamp, F.map_from_arrays("tags", "values").alias("values"))
    lines = tagged.select("equipment_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("append").partitionBy("equipment_id").text(path)


def calibration_read(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-line samples; a damaged line, or one without timestamp or values, is skipped."""
    lines = spark.read.text(path)
    return (
        lines.withColumn("sample", F.from_json("value", SAMPLE_SCHEMA + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
        .filter(F.col("sample._bad").isNull() & F.col("sample.timestamp").isNotNull() & F.col("sample.values").isNotNull())
        .select(
            *[c for c in lines.columns if c != "value"],
            F.try_to_timestamp("sample.timestamp").alias("ts"),
            F.col("sample.values").alias("values"),
        )
    )


def calibration_count(samples: DataFrame) -> DataFrame:
    return samples.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n_samples"))


def retention_cutoff(now: Column, max_duration: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - parse_duration(max_duration) * 1_000_000)


def _cutoffs(config: DataFrame, now: DataFrame) -> DataFrame:
    """``(equipment_id, cutoff)``: the oldest time that each equipment in ``now`` keeps."""
    return now.join(config.select("equipment_id", "max_duration"), KEYS).select(
        "equipment_id", retention_cutoff(F.col("now"), F.col("max_duration")).alias("cutoff")
    )


def calibration_prune(samples: DataFrame, config: DataFrame, now: DataFrame) -> DataFrame:
    """Samples not older than the equipment's ``max_duration`` at its time in ``now(equipment_id, now)``.

    An equipment without a time in ``now``, or without a readable ``max_duration``, keeps all its samples.
    """
    limited = samples.join(_cutoffs(config, now), KEYS, "left")
    return limited.filter(F.col("cutoff").isNull() | (F.col("ts") >= F.col("cutoff"))).drop("cutoff")


def calibration_clear(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """What is left after clears: samples of the current episode while it is still CALIBRATING.

    Training or recalibrating starts a new interval, so older rows drop out of view at once;
    their files can be removed later without touching a reader.
    """
    current = intervals.filter(F.col("valid_to").isNull() & (F.col("state") == "CALIBRATING"))
    return samples.join(current.select("equipment_id", "episode"), ["equipment_id", "episode"], "left_semi")
