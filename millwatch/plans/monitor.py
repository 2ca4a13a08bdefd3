"""The whole chain: readings and commands to scored ticks with alarms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.functions.scalars import floor_div
from millwatch.operators.buckets import BUCKET, BUCKET_TICKS, add_bucket, spread
from millwatch.operators.control import control_intervals, state_asof, train_attempts
from millwatch.operators.linear import fit_windows, pack_windows, window_errors
from millwatch.operators.model import (
    VERSION,
    align_models,
    error_stats,
    fit_forecaster,
    pack_model,
    raw_errors,
)
from millwatch.operators.scoring import ALARM_THRESHOLD, CONFIRM_TICKS, debounce, top_deviant
from millwatch.operators.settings import TRAIN_SETTINGS, by_era, clip_intervals, settings_eras, split_unit, unit_config
from millwatch.operators.snapshots import asof_snapshot, number_snapshots, with_window_state
from millwatch.session import stage


@dataclass(frozen=True)
class Settings:
    threshold: float = ALARM_THRESHOLD
    confirm: int = CONFIRM_TICKS
    # A train uses every sample its episode retains; a number here keeps the newest only.
    max_training: int | None = None
    bucket_ticks: int = BUCKET_TICKS
    forecaster: str = "line"
    # Writes the two results that later passes read again; ``lambda df, name: df`` stays lazy.
    stage: Callable[[DataFrame, str], DataFrame] = stage


def windowed_snapshots(readings: DataFrame, config: DataFrame, s: Settings) -> DataFrame:
    until = F.col("until_tick") if "until_tick" in config.columns else None
    snapshots = asof_snapshot(readings, config, s.bucket_ticks, until)
    return with_window_state(number_snapshots(snapshots, s.bucket_ticks), config, s.bucket_ticks)


def with_models(rows: DataFrame, models: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Rows joined to their model, laid out by bucket.

    Each model is repeated for the buckets between its first and last row. A shuffle join is then on (model, bucket): the rows of a
    machine that holds a third of all stay apart, and what is summed per model afterwards is exchanged again.
    """
    spans = rows.groupBy(*VERSION).agg(F.min("tick").alias("_lo"), F.max("tick").alias("_hi"))
    buckets = F.explode(F.sequence(floor_div(F.col("_lo"), size), floor_div(F.col("_hi"), size)))
    per_bucket = models.join(spans.select(*VERSION, buckets.alias(BUCKET)), VERSION)
    placed = spread(add_bucket(rows, "tick", size), VERSION)
    return placed.join(per_bucket, [*VERSION, BUCKET]).drop(BUCKET)


def fit_models(training: DataFrame, config: DataFrame, forecaster: str = "line", size: int = BUCKET_TICKS) -> DataFrame:
    """One row per (equipment, version): tags, types, normalisation, forecast and error spread.

    ``training`` needs ``tick``, ``values``, ``prev`` and ``fit``. It is read twice, because the spread of
    the error depends on the fitted forecast. ``forecaster`` is ``line`` (each tag from itself, one snapshot back)
    or ``linear`` (each tag from all tags of the whole window; needs ``seq`` and ``window_size`` too).
    """
    if forecaster not in ("line", "linear"):
        raise ValueError(f"unknown forecaster {forecaster!r}")
    forecast = pack_model(fit_forecaster(training))
    if forecaster == "linear":
        forecast = stage(forecast, "normalisation")
        coef, blocks = fit_windows(training, forecast, size)
        forecast = stage(forecast.join(coef.drop("n_windows"), VERSION), "forecast")
        errors = window_errors(blocks, forecast)
    else:
        errors = raw_errors(with_models(training.filter("fit").select(*VERSION, "tick", "values", "prev"), forecast))
    spread_of = pack_model(error_stats(errors), ("err_mean", "err_std"))
    settings = config.select("equipment_id", "tags", F.col("window_size").alias("window_size"))
    return forecast.join(spread_of, VERSION).join(settings, "equipment_id")


def score_rows(rows: DataFrame, models: DataFrame, config: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Anomaly score of usable rows under their model.

    A model's arrays are first put in today's config order by tag. Rows of a model with another window
    size or other tags get no score. Where ``rows`` have a ``target`` column, only rows with it are scored. Models that see the whole window
    (``coef``) need that: ``rows`` then holds every snapshot, with ``seq`` and ``window_size``, since a window reaches back to rows that are not scored.
    """
    fitting = align_models(models, config)
    if "coef" not in models.columns:
        live = rows.filter("target") if "target" in rows.columns else rows
        scored = raw_errors(with_models(live.select(*VERSION, "tick", "values", "prev"), fitting, size))
    elif "target" not in rows.columns:
        raise ValueError("models of the whole window need all snapshots and a column `target`")
    else:
        scored = with_models(window_errors(pack_windows(rows, size), fitting), fitting.drop("coef"), size)
    return top_deviant(scored).select(*VERSION, "tick", "anomaly_score", "top_deviant_tag")


def monitor(readings: DataFrame, commands: DataFrame, config: DataFrame, s: Settings) -> DataFrame:
    """``(equipment_id, model_version, tick, anomaly_score, top_deviant_tag, alarm)``.

    ``commands`` are parsed. Every ``train`` of the log that succeeds fits one model; ticks while
    MONITORING are scored with the model of their episode.
    """
    snapshots = s.stage(windowed_snapshots(readings, config, s), "snapshots")
    attempts = train_attempts(snapshots, commands, config, s.max_training, s.bucket_ticks)
    tagged = state_asof(snapshots, control_intervals(attempts, commands, config), s.bucket_ticks)
    if s.forecaster == "line":
        # Windows reach back to snapshots of any state; a line needs those under a model only.
        tagged = tagged.filter(F.col("model_version").isNotNull())
    tagged = s.stage(tagged, "tagged")
    in_range = (F.col("seq") >= F.col("fit_lo")) & (F.col("seq") < F.col("fit_hi"))
    training = tagged.filter((F.col("state") == "CALIBRATING") & in_range).withColumn(
        "fit", F.col("usable") & (F.col("seq") - F.col("window_size") >= F.col("fit_lo"))
    )
    live = tagged.withColumn("target", (F.col("state") == "MONITORING") & F.col("usable") & F.col("model_version").isNotNull())
    models = fit_models(training, config, s.forecaster, s.bucket_ticks)
    scores = s.stage(score_rows(live, models, config, s.bucket_ticks), "scores")
    return debounce(scores, s.threshold, s.confirm, s.bucket_ticks)


def monitor_history(readings: DataFrame, commands: DataFrame, history: DataFrame, s: Settings) -> DataFrame:
    """``monitor`` under settings that changed: ``(equipment_id, era, model_version, tick, ...)``, see ``settings_eras``.

    After a change that breaks the model nothing is scored until a train of the new era succeeds. Model versions count within an era.
    """
    eras = s.stage(settings_eras(history), "eras")
    rows, log = by_era(readings, eras), by_era(commands, eras, also=TRAIN_SETTINGS)
    return split_unit(monitor(rows, log, unit_config(eras), s))


def control_history(readings: DataFrame, commands: DataFrame, history: DataFrame, s: Settings) -> DataFrame:
    """State intervals under settings that changed, each within its era; ``cause`` names the change that sent a machine back to CALIBRATING."""
    eras = s.stage(settings_eras(history), "eras")
    config, log = unit_config(eras), by_era(commands, eras, also=TRAIN_SETTINGS)
    snapshots = s.stage(windowed_snapshots(by_era(readings, eras), config, s), "snapshots")
    attempts = train_attempts(snapshots, log, config, s.max_training, s.bucket_ticks)
    return clip_intervals(control_intervals(attempts, log, config), eras)
