"""Continuous snapshots, control and monitoring.

Each micro-batch runs the batch operators on the new ticks only, with a small carried state:
last value per tag, readings of open ticks, the last window of snapshots, and the last scored
ticks. So a stream gives the rows the batch job gives, and a busy equipment is spread over
buckets here too instead of being pinned to the one task that owns its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators.buckets import BUCKET_TICKS
from millwatch.functions.scalars import tick_of
from millwatch.operators.control import control_intervals, state_asof, train_attempts, unseen_tags
from millwatch.operators.model import VERSION
from millwatch.operators.scoring import ALARM_THRESHOLD, CONFIRM_TICKS, debounce, result_envelope
from millwatch.operators.snapshots import (
    last_points,
    number_snapshots,
    placed_readings,
    snapshot_grid,
    with_window_state,
)
from millwatch.plans.monitor import fit_models, score_rows
from millwatch.session import stage
from millwatch.sources.models import MODEL_SCHEMA
from millwatch.streaming.state import BatchTables

POINT_SCHEMA = "equipment_id STRING, pos INT, tick BIGINT, value DOUBLE, at {at}"
HELD_SCHEMA = "equipment_id STRING, pos INT, tick BIGINT, value DOUBLE"
CLOCK_SCHEMA = "equipment_id STRING, newest_us BIGINT"
LATE_SCHEMA = "equipment_id STRING, pos INT, tick BIGINT"
SNAPSHOT_SCHEMA = (
    "equipment_id STRING, tick BIGINT, seq BIGINT, values ARRAY<DOUBLE>, window_size INT, prev ARRAY<DOUBLE>, usable BOOLEAN"
)
TAIL_SCHEMA = "equipment_id STRING, tick BIGINT, seq BIGINT, values ARRAY<DOUBLE>, window_size INT"
COMMAND_SCHEMA = "equipment_id STRING, ts TIMESTAMP, command STRING, ord BIGINT"
SCORE_SCHEMA = "equipment_id STRING, model_version BIGINT, tick BIGINT, anomaly_score DOUBLE, top_deviant_tag STRING"
ALARM_SCHEMA = SCORE_SCHEMA + ", alarm BOOLEAN"
ENVELOPE_SCHEMA = "equipment_id STRING, tick BIGINT, topic STRING, payload STRING"
ATTEMPT_SCHEMA = (
    "equipment_id STRING, episode BIGINT, tick BIGINT, n_samples BIGINT, fit_lo BIGINT, fit_hi BIGINT, reason STRING, "
    "unseen_tags ARRAY<STRING>"
)
INTERVAL_SCHEMA = (
    "equipment_id STRING, episode BIGINT, state STRING, valid_from BIGINT, valid_to BIGINT, "
    "model_version BIGINT, fit_lo BIGINT, fit_hi BIGINT"
)


def newest_stamps(readings: DataFrame, before: DataFrame, config: DataFrame) -> DataFrame:
    """Each equipment's clock after a batch: ``(equipment_id, was_us, now_us)``.

    An equipment's clock is its own newest reading, so a wrong stamp holds back or rushes no other equipment.
    Where readings carry ``received_at``, a stamp counts up to its time of receipt only, and the newest receipt of any
    equipment moves all clocks: an equipment that fell silent still ticks while the line delivers.
    """
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    if "received_at" in readings.columns:
        received = F.unix_micros(F.col("received_at").cast("timestamp"))
        own = readings.groupBy("equipment_id").agg(F.max(F.least(stamp, received)).alias("seen_us"), F.max(received).alias("line_us"))
        line = own.agg(F.max("line_us").alias("line_us"))
        seen = config.select("equipment_id").join(own.drop("line_us"), "equipment_id", "left")
        # One row that every equipment gets: the newest receipt as a scalar.
        newest = line.first()["line_us"]
        seen = seen.withColumn("seen_us", F.greatest("seen_us", F.lit(newest).cast("long")))
    else:
        seen = readings.groupBy("equipment_id").agg(F.max(stamp).alias("seen_us"))
    clocks = config.select("equipment_id").join(before, "equipment_id", "left").join(seen, "equipment_id", "left")
    return clocks.select("equipment_id", F.col("newest_us").alias("was_us"), F.greatest("newest_us", "seen_us").alias("now_us"))


def heartbeats(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of ``received_at``, one row per beat of the wall clock."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return beats.select(F.col("timestamp").alias("received_at"))


def with_heartbeats(readings: DataFrame, beats: DataFrame) -> DataFrame:
    """Readings with rows that carry nothing but a time of receipt.

    A micro-batch runs when rows arrive, and clocks move with the newest receipt. So with beats in the stream the ticks of
    a machine, or of a whole line, that fell silent still close: values are held, snapshots scored, alarms counted and commands
    applied, as on a line that delivers.
    """
    if "received_at" not in readings.columns:
        raise ValueError("heartbeats need readings that carry received_at")
    return readings.unionByName(beats.select("received_at"), allowMissingColumns=True)


def snapshot_step(
    readings: DataFrame,
    config: DataFrame,
    tables: BatchTables,
    batch: int,
    delay_ms: int,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Close the ticks that each equipment's clock has passed by ``delay_ms`` and emit their snapshots.

    A change point of a closed tick comes too late: it goes to the ``late`` table and changes nothing else.
    """
    clocks = newest_stamps(readings, tables.read("clock", batch - 1, CLOCK_SCHEMA), config)
    clocks = tables.write_state(clocks, "clocks", batch)
    step = F.col("resample_interval_ms").cast("long") * 1000

    def closed(us: str) -> Column:
        return F.floor((F.col(us) - F.lit(delay_ms * 1000)) / step)

    timed = config.join(clocks, "equipment_id")
    edges = timed.select("equipment_id", closed("was_us").alias("was"), closed("now_us").alias("now"))
    new = placed_readings(readings, config)
    pending = tables.read("pending", batch - 1, POINT_SCHEMA.format(at=dict(new.dtypes)["at"]))
    held = tables.read("held", batch - 1, HELD_SCHEMA)
    points = tables.write_state(
        last_points(new.unionByName(pending)).join(edges, "equipment_id"),
        "points",
        batch,
    )
    late = F.coalesce(F.col("tick") <= F.col("was"), F.lit(False))
    tables.write(points.filter(late).select("equipment_id", "pos", "tick"), "late", batch)
    points = points.filter(~late)
    ready = F.col("now").isNotNull() & (F.col("tick") <= F.col("now"))
    tables.write_state(points.filter(~ready).drop("was", "now"), "pending", batch)
    closing = held.unionByName(points.filter(ready).select(*held.columns))
    fresh = snapshot_grid(closing, timed, size, closed("now_us")).join(edges, "equipment_id")
    fresh = fresh.filter(F.col("was").isNull() | (F.col("tick") > F.col("was"))).drop("was", "now", "bucket")

    tail = tables.read("tail", batch - 1, TAIL_SCHEMA)
    base = tail.groupBy("equipment_id").agg((F.max("seq") + 1).alias("base"))
    numbered = (
        number_snapshots(fresh, size)
        .join(base, "equipment_id", "left")
        .withColumn("seq", F.col("seq") + F.coalesce("base", F.lit(0)))
        .drop("base")
    )
    around = numbered.unionByName(tail.select(*numbered.columns))
    windows = with_window_state(around, config, size).join(
        base, "equipment_id", "left"
    ).filter(F.col("seq") >= F.coalesce("base", F.lit(0))).drop("base")
    emitted = tables.write(windows.select(*[c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]), "snapshots", batch)

    # Numbers have no gaps, so the last window needs no ranking.
    last = emitted.select(*tail.columns).unionByName(tail)
    top = last.groupBy("equipment_id").agg(F.max("seq").alias("top"))
    last = last.join(top, "equipment_id").filter(F.col("seq") > F.col("top") - F.col("window_size")).drop("top")
    tables.write_state(last, "tail", batch)
    last_value = closing.groupBy("equipment_id", "pos").agg(F.max_by("value", "tick").alias("value"))
    tables.write_state(
        last_value.join(edges, "equipment_id").select("equipment_id", "pos", F.col("now").alias("tick"), "value"), "held", batch
    )
    tables.write_state(clocks.select("equipment_id", F.col("now_us").alias("newest_us")).filter("newest_us IS NOT NULL"), "clock", batch)
    return emitted


def stream_snapshots(
    readings: DataFrame,
    config: Callable[[], DataFrame],
    root: str,
    delay_ms: int,
    on_snapshots: Callable[[DataFrame, BatchTables, int], object] | None = None,
    beats: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the snapshot stream. ``config`` is read again in each batch.

    ``delay_ms`` is how long a tick waits for readings that are out of order. With ``beats`` (see ``heartbeats``) ticks
    close on a silent line too.

    ``on_snapshots`` gets the new snapshots of a batch, e.g. to score them.
    """

    def step(rows: DataFrame, batch: int) -> None:
        tables = BatchTables(rows.sparkSession, root)
        emitted = snapshot_step(rows, config(), tables, batch, delay_ms)
        if on_snapshots is not None:
            on_snapshots(emitted, tables, batch)

    readings = readings if beats is None else with_heartbeats(readings, beats)
    return readings.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(**trigger).start()


def monitor_step(
    snapshots: DataFrame,
    intervals: DataFrame | None,
    models: DataFrame,
    config: DataFrame,
    tables: BatchTables,
    batch: int,
    threshold: float = ALARM_THRESHOLD,
    confirm: int = CONFIRM_TICKS,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Score new snapshots and decide alarms. ``intervals`` and ``models`` are today's tables.

    Without intervals every equipment is monitored with its one given model. The last
    ``confirm - 1`` scored ticks of a model are kept, which is all that an alarm looks back on.
    """
    live = snapshots.filter("usable")
    if intervals is None:
        live = live.join(models.select(*VERSION), "equipment_id")
    else:
        live = state_asof(live, intervals, size).filter(
            (F.col("state") == "MONITORING") & F.col("model_version").isNotNull()
        )
    scores = tables.write(score_rows(live, models, config), "scores", batch)
    recent = tables.read("recent", batch - 1, SCORE_SCHEMA).withColumn("old", F.lit(True))
    rows = scores.withColumn("old", F.lit(False)).unionByName(recent)
    alarms = debounce(rows, threshold, confirm, size).filter(~F.col("old")).drop("old")
    emitted = tables.write(alarms.select(*[c.split()[0] for c in ALARM_SCHEMA.split(", ")]), "alarms", batch)
    newest = W.partitionBy(*VERSION).orderBy(F.desc("tick"))
    kept = rows.drop("old").withColumn("r", F.row_number().over(newest)).filter(F.col("r") < confirm)
    tables.write_state(kept.drop("r"), "recent", batch)
    return emitted


def control_step(
    commands: DataFrame,
    snapshots: DataFrame,
    config: DataFrame,
    tables: BatchTables,
    batch: int,
    max_training: int | None = None,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Apply new commands: derive the state intervals and fit a model for each new success.

    The command log is small and kept whole. A batch without commands ends at once and reads no snapshot; otherwise
    only the snapshots of equipments with new commands are read, and only versions that are not in the models
    table yet are fitted.
    """
    names = [c.split()[0] for c in COMMAND_SCHEMA.split(", ")]
    new = tables.write(commands.select(*names), "commands", batch)
    known = tables.read("intervals", batch - 1, INTERVAL_SCHEMA)
    touched = new.select("equipment_id").distinct()
    if new.isEmpty() and batch > 0:
        tables.write(tables.spark.createDataFrame([], MODEL_SCHEMA), "models", batch)
        tables.write(tables.spark.createDataFrame([], ATTEMPT_SCHEMA), "attempts", batch)
        return tables.write_state(known, "intervals", batch)
    log = tables.all_batches("commands", COMMAND_SCHEMA, batch)
    if batch > 0:
        snapshots, log = (df.join(touched, "equipment_id", "left_semi") for df in (snapshots, log))
        changed = config.join(touched, "equipment_id", "left_semi")
    else:
        changed = config
    attempts = stage(train_attempts(snapshots, log, changed, max_training, size), "attempts")
    asked = attempts.join(new.filter("command = 'train'").select("equipment_id").distinct(), "equipment_id", "left_semi")
    tables.write(unseen_tags(asked, snapshots, changed, size), "attempts", batch)
    spans = control_intervals(attempts, log, changed)
    intervals = tables.write_state(spans.unionByName(known.join(changed, "equipment_id", "left_anti")), "intervals", batch)
    won = intervals.join(changed, "equipment_id", "left_semi").filter("model_version IS NOT NULL AND state = 'CALIBRATING'")
    if batch > 0:
        fitted = tables.all_batches("models", MODEL_SCHEMA, batch - 1)
        won = won.join(fitted.select(*VERSION), VERSION, "left_anti")
    won = tables.write_state(won, "won", batch)
    # Only the snapshots that a new model is fitted to are placed, and both passes of the fit read them from a table.
    concerned = snapshots.join(won.select("equipment_id").distinct(), "equipment_id", "left_semi")
    training = (
        state_asof(concerned, won, size)
        .filter((F.col("seq") >= F.col("fit_lo")) & (F.col("seq") < F.col("fit_hi")))
        .withColumn("fit", F.col("usable") & (F.col("seq") - F.col("window_size") >= F.col("fit_lo")))
    )
    training = tables.write_state(training.select(*VERSION, "tick", "values", "prev", "fit"), "training", batch)
    models = fit_models(training, config)
    tables.write(models.select(*[c.split()[0] for c in MODEL_SCHEMA.split(", ")]), "models", batch)
    tables.drop("training", batch)
    return intervals


def stream_control(
    commands: DataFrame,
    snapshots: Callable[[], DataFrame],
    config: Callable[[], DataFrame],
    root: str,
    max_training: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the control stream over parsed commands ``(equipment_id, ts, command, ord)``."""

    def step(rows: DataFrame, batch: int) -> None:
        control_step(rows, snapshots(), config(), BatchTables(rows.sparkSession, root), batch, max_training)

    return commands.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(**trigger).start()


def pipeline_step(
    readings: DataFrame,
    commands: DataFrame,
    config: DataFrame,
    tables: BatchTables,
    batch: int,
    delay_ms: int,
    collector: str,
) -> DataFrame:
    """One micro-batch of the whole job: snapshots, control, scores, alarms, and the messages to publish.

    ``commands`` is the parsed command log. A command takes effect in the batch that closes its tick, so the snapshots before
    it are complete and those after it are judged by the state and model it leads to.
    """
    emitted = snapshot_step(readings, config, tables, batch, delay_ms)
    clocks = tables.read("clocks", batch, "equipment_id STRING, was_us BIGINT, now_us BIGINT")
    step = F.col("resample_interval_ms").cast("long") * 1000
    edges = config.join(clocks, "equipment_id").select(
        "equipment_id",
        "resample_interval_ms",
        *(F.floor((F.col(f"{n}_us") - F.lit(delay_ms * 1000)) / step).alias(n) for n in ("was", "now")),
    )
    at = tick_of(F.col("ts"), F.col("resample_interval_ms"))
    due = commands.join(edges, "equipment_id").filter((at <= F.col("now")) & (F.col("was").isNull() | (at > F.col("was"))))
    history = tables.all_batches("snapshots", SNAPSHOT_SCHEMA, batch)
    intervals = control_step(due, history, config, tables, batch)
    models = tables.all_batches("models", MODEL_SCHEMA, batch)
    alarms = monitor_step(emitted, intervals, models, config, tables, batch)
    return tables.write(result_envelope(alarms, config, collector), "envelopes", batch)


def stream_pipeline(
    readings: DataFrame,
    commands: Callable[[], DataFrame],
    config: Callable[[], DataFrame],
    root: str,
    delay_ms: int,
    collector: str,
    on_envelopes: Callable[[DataFrame, int], object] | None = None,
    beats: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the whole job over a stream of readings; ``on_envelopes`` sends a batch's messages on.

    With ``beats`` (see ``heartbeats``) the job goes on while no reading arrives.
    """

    def step(rows: DataFrame, batch: int) -> None:
        sent = pipeline_step(rows, commands(), config(), BatchTables(rows.sparkSession, root), batch, delay_ms, collector)
        if on_envelopes is not None:
            on_envelopes(sent, batch)

    readings = readings if beats is None else with_heartbeats(readings, beats)
    return readings.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(**trigger).start()
