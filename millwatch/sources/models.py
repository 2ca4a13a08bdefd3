"""Stored models: one row per equipment and version.

A save adds rows and never rewrites files; of several saves of one version readers see the last, so a
repeated save changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_SCHEMA = (
    "equipment_id STRING, model_version BIGINT, window_size INT, tags ARRAY<STRING>, tag_type ARRAY<STRING>, "
    "norm_mean ARRAY<DOUBLE>, norm_std ARRAY<DOUBLE>, slope ARRAY<DOUBLE>, offset ARRAY<DOUBLE>, "
    "err_mean ARRAY<DOUBLE>, err_std ARRAY<DOUBLE>"
)
# Present when the models see every tag.
LINEAR_SCHEMA = MODEL_SCHEMA + ", coef ARRAY<ARRAY<DOUBLE>>"


def model_save(models: DataFrame, path: str) -> None:
    schema = LINEAR_SCHEMA if "coef" in models.columns else MODEL_SCHEMA
    columns = [part.split()[0] for part in schema.split(", ")]
    saved = models.select(*columns).withColumn("saved_ns", F.lit(time.time_ns()))
    saved.write.mode("append").parquet(path)


def model_load(spark: SparkSession, path: str, newest: bool = True, linear: bool = False) -> DataFrame:
    """All stored models, or each equipment's newest version. A path holds one kind of model."""
    rows = spark.read.schema((LINEAR_SCHEMA if linear else MODEL_SCHEMA) + ", saved_ns BIGINT").parquet(path)
    columns = [c for c in rows.columns if c != "saved_ns"]
    last = F.max_by(F.struct(*columns), "saved_ns").alias("m")
    models = rows.groupBy("equipment_id", "model_version").agg(last).select("m.*")
    if not newest:
        return models
    last = models.groupBy("equipment_id").agg(F.max("model_version").alias("model_version"))
    return models.join(last, ["equipment_id", "model_version"])
