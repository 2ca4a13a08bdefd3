"""Anomaly scores, the debounced alarm and the published record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.operators.buckets import BUCKET_TICKS, add_run_length
from millwatch.operators.model import VERSION

# Alarm rule.
ALARM_THRESHOLD = 3.0
CONFIRM_TICKS = 3


def top_deviant(with_errors: DataFrame) -> DataFrame:
    """Add ``anomaly_score`` and ``top_deviant_tag``: the largest z-score over the tags of a row.

    Equal scores go to the first tag, continuous tags before binary ones, each in config order.
    Needs ``errors``, ``err_mean``, ``err_std``, ``tag_type`` and ``tags`` arrays.
    """

    def candidate(error: Column, i: Column) -> Column:
        kind = F.when(F.get("tag_type", i) == "binary", F.lit(1)).otherwise(F.lit(0))
        z = (error - F.get("err_mean", i)) / F.get("err_std", i)
        return F.struct(z.alias("z"), (-kind).alias("kind"), (-i).alias("place"), F.get("tags", i).alias("tag"))

    best = F.array_max(F.transform("errors", candidate))
    return (
        with_errors.withColumn("best", best)
        .withColumn("anomaly_score", F.col("best.z"))
        .withColumn("top_deviant_tag", F.col("best.tag"))
        .drop("best")
    )


def debounce(
    scores: DataFrame,
    threshold: float = ALARM_THRESHOLD,
    confirm: int = CONFIRM_TICKS,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Add ``alarm``: true once ``confirm`` scored ticks in a row reach the threshold.

    Only scored ticks are rows here, so unscored ones neither count nor reset. A new model
    version starts over.
    """
    if confirm <= 0:
        raise ValueError("confirm must be positive")
    run = add_run_length(scores, VERSION, "tick", F.col("anomaly_score") >= F.lit(threshold), size, "run")
    return run.withColumn("alarm", F.col("run") >= confirm).drop("run")


def result_envelope(alarms: DataFrame, config: DataFrame, collector: str) -> DataFrame:
    """One JSON message per scored tick, ready for the equipment's publish topic.

    ``collector`` is the prefix that consumers expect in front of the three result fields.
    """
    settings = config.select("equipment_id", "publish_topic", "resample_interval_ms")
    at = F.timestamp_micros(F.col("tick") * F.col("resample_interval_ms").cast("long") * 1000)
    record = F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.col("anomaly_score").alias(f"{collector}:anomaly_score"),
        F.col("alarm").alias(f"{collector}:alarm"),
        F.col("top_deviant_tag").alias(f"{collector}:top_deviant_tag"),
    )
    return alarms.join(settings, "equipment_id").select(
        "equipment_id",
        "tick",
        F.col("publish_topic").alias("topic"),
        F.to_json(F.struct(F.array(record).alias("records"))).alias("payload"),
    )
