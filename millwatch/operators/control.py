"""Commands and calibration samples to state intervals, without a row-by-row state machine.

A ``recalibrate`` starts an episode. Inside it the first ``train`` that finds enough retained
samples, and at least one full window among those it may use, succeeds; the equipment is then
MONITORING until the next episode. Sample counts are differences of snapshot numbers, so a train
needs two lookups and never counts rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions.scalars import parse_duration, state_or_default, tick_of
from millwatch.operators.buckets import BUCKET_TICKS, asof_last, within_intervals
from millwatch.operators.snapshots import KEYS

def command_ticks(commands: DataFrame, config: DataFrame) -> DataFrame:
    """One row per equipment and tick with commands: does a train come first, is there a recalibrate?

    No snapshot falls between two commands of a tick, so a train after a recalibrate in the same
    tick finds no samples and is always rejected. Where commands carry the settings of their time, the first train's are kept.
    """
    carried = [c for c in ("min_samples", "max_duration") if c in commands.columns]
    at = F.struct("ts", "ord", *carried)
    first = {c: F.min(F.when(F.col("command") == c, at)) for c in ("train", "recalibrate")}
    settings = config.select("equipment_id", "resample_interval_ms")
    return (
        commands.join(settings, KEYS)
        .withColumn("tick", tick_of(F.col("ts"), F.col("resample_interval_ms")))
        .groupBy("equipment_id", "tick")
        .agg(first["train"].alias("train"), first["recalibrate"].alias("recalibrate"))
        .select(
            "equipment_id",
            "tick",
            (F.col("train").isNotNull() & (F.col("recalibrate").isNull() | (F.col("train") < F.col("recalibrate")))).alias("train"),
            F.col("recalibrate").isNotNull().alias("recalibrate"),
            *(F.col(f"train.{c}").alias(c) for c in carried),
        )
    )


def train_attempts(
    snapshots: DataFrame,
    commands: DataFrame,
    config: DataFrame,
    max_training: int | None = None,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Every train command with the samples it finds: ``n_samples``, fit range and ``reason``.

    ``snapshots`` needs ``tick``, ``seq`` and ``usable``. A train sees the snapshots of its
    episode that are younger than ``max_duration``; ``fit_lo`` to ``fit_hi`` (exclusive) numbers
    those the model uses: all of them, or the newest ``max_training`` if a caller asks for that.
    ``reason`` is null when the train can succeed.
    """
    log = W.partitionBy("equipment_id").orderBy("tick")
    before = log.rowsBetween(W.unboundedPreceding, -1)
    retained = (
        F.floor(parse_duration(F.col("max_duration")) * F.lit(1000) / F.col("resample_interval_ms"))
    )
    ticks = command_ticks(commands, config)
    trains = (
        ticks
        .withColumn("episode", F.coalesce(F.sum(F.col("recalibrate").cast("long")).over(before), F.lit(0)))
        .withColumn("since", F.max(F.when(F.col("recalibrate"), F.col("tick"))).over(before))
        .filter("train")
        .join(config.drop(*(c for c in ticks.columns if c != "equipment_id")), KEYS)
        .select(
            "equipment_id",
            "episode",
            F.col("tick").alias("at"),
            F.greatest("since", F.col("tick") - retained).alias("from"),
            "min_samples",
            "window_size",
        )
    )
    ends = F.explode(F.array("from", "at")).alias("tick")
    probes = trains.select("*", ends)
    points = snapshots.select(
        "equipment_id", "tick", F.col("seq").alias("newest"), F.when(F.col("usable"), F.col("seq")).alias("newest_usable")
    )
    found = asof_last(probes, points, KEYS, "tick", ["newest", "newest_usable"], size, inclusive=False)
    count = F.coalesce(F.col("newest") + 1, F.lit(0))
    is_end = F.col("tick") == F.col("at")
    cap = F.lit(0) if max_training is None else F.col("fit_hi") - F.lit(max_training)
    return (
        found.groupBy("equipment_id", "episode", "at", "min_samples", "window_size")
        .agg(
            F.max(F.when(is_end, count)).alias("fit_hi"),
            F.max(F.when(~is_end, count)).alias("kept_from"),
            F.max(F.when(is_end, F.col("newest_usable"))).alias("newest_usable"),
        )
        .withColumn("n_samples", F.col("fit_hi") - F.col("kept_from"))
        .withColumn("fit_lo", F.greatest("kept_from", cap))
        .withColumn(
            "reason",
            F.when(F.col("n_samples") < F.col("min_samples"), "too few samples").when(
                F.coalesce(F.col("newest_usable") - F.col("window_size"), F.lit(-1)) < F.col("fit_lo"),
                "no full window to train on",
            ),
        )
        .select("equipment_id", "episode", F.col("at").alias("tick"), "n_samples", "fit_lo", "fit_hi", "reason")
    )


def unseen_tags(attempts: DataFrame, snapshots: DataFrame, config: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Attempts with ``unseen_tags``: the configured tags, in their order, without any value among the samples of a train that found no full window.

    Null for attempts that succeed or have too few samples. A tag is unseen where its last value before the train is older than the
    first sample the train may use, so each tag needs one lookup of a snapshot number, and no range of rows is counted.
    """
    keys = [*KEYS, "pos"]
    refused = attempts.filter("reason = 'no full window to train on'").select(*KEYS, "episode", "tick", "fit_lo")
    probes = refused.join(config.select(*KEYS, F.posexplode("tags").alias("pos", "tag")), KEYS)
    concerned = snapshots.join(refused.select(*KEYS).distinct(), KEYS, "left_semi")
    cells = concerned.select(*KEYS, "tick", "seq", F.posexplode("values").alias("pos", "value"))
    seen = cells.filter(F.col("value").isNotNull()).select(*keys, "tick", F.col("seq").alias("last_seen"))
    found = asof_last(probes, seen, keys, "tick", ["last_seen"], size, inclusive=False)
    missing = found.filter(F.col("last_seen").isNull() | (F.col("last_seen") < F.col("fit_lo")))
    named = missing.groupBy(*KEYS, "episode", "tick").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("m"))
    named = named.select(*KEYS, "episode", "tick", F.col("m.tag").alias("unseen_tags"))
    none = F.when(F.col("reason") == "no full window to train on", F.array().cast("array<string>"))
    return attempts.join(named, [*KEYS, "episode", "tick"], "left").withColumn("unseen_tags", F.coalesce("unseen_tags", none)).select(
        *attempts.columns, "unseen_tags"
    )


def train_gate(counts: DataFrame, config: DataFrame) -> DataFrame:
    """May a train start with this many samples? ``counts`` needs ``n_samples``."""
    return counts.join(config.select("equipment_id", "min_samples"), KEYS).withColumn(
        "allowed", F.col("n_samples") >= F.col("min_samples")
    )


def control_intervals(
    attempts: DataFrame, commands: DataFrame, config: DataFrame
) -> DataFrame:
    """``(equipment_id, episode, state, valid_from, valid_to, model_version, fit_lo, fit_hi)``.

    ``valid_from`` is null for the state before any command, ``valid_to`` for the current one.
    A CALIBRATING row of an episode that later succeeds already names its model and fit range,
    which tells training rows apart. The model of an ended episode is kept but not used.
    """
    success = (
        attempts.filter(F.col("reason").isNull())
        .groupBy("equipment_id", "episode")
        .agg(F.min(F.struct("tick", "fit_lo", "fit_hi")).alias("s"))
        .select("equipment_id", "episode", F.col("s.tick").alias("trained"), "s.fit_lo", "s.fit_hi")
    )
    log = W.partitionBy("equipment_id").orderBy("start")
    recalibrations = command_ticks(commands, config).filter("recalibrate")
    episodes = (
        config.select("equipment_id", F.lit(None).cast("long").alias("start"))
        .unionByName(recalibrations.select("equipment_id", F.col("tick").alias("start")))
        .withColumn("episode", (F.row_number().over(log.orderBy(F.col("start").asc_nulls_first())) - 1).cast("long"))
        .withColumn("end", F.lead("start").over(log.orderBy(F.col("start").asc_nulls_first())))
        .join(success, ["equipment_id", "episode"], "left")
        # A recalibrate in the tick of the train leaves the model no time: it is never fitted or named.
        .withColumn("trained", F.when(F.col("end").isNull() | (F.col("trained") < F.col("end")), F.col("trained")))
    )

    def span(state: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), lo.alias("valid_from"), hi.alias("valid_to"))

    trained, end = F.col("trained"), F.col("end")
    spans = F.array(
        span("CALIBRATING", F.col("start"), F.coalesce(trained, end)),
        F.when(trained.isNotNull(), span("MONITORING", trained, end)),
    )
    version, used = F.when(trained.isNotNull(), F.col("episode")), trained.isNotNull()
    return (
        episodes.select(
            "equipment_id", "episode", F.explode(F.array_compact(spans)).alias("s"), version.alias("model_version"),
            F.when(used, F.col("fit_lo")).alias("fit_lo"), F.when(used, F.col("fit_hi")).alias("fit_hi"),
        )
        .select("equipment_id", "episode", "s.*", "model_version", "fit_lo", "fit_hi")
        # An episode that starts and ends in one tick has no time.
        .filter(F.col("valid_to").isNull() | F.col("valid_from").isNull() | (F.col("valid_from") < F.col("valid_to")))
    )


STATE_COLUMNS = ["state", "episode", "model_version", "fit_lo", "fit_hi"]


def state_asof(rows: DataFrame, intervals: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Attach the state and model that held at each row's tick.

    The intervals of a configured equipment cover all time, so every row keeps its place.
    """
    spans = intervals.select("equipment_id", "valid_from", "valid_to", *STATE_COLUMNS)
    joined = within_intervals(rows, spans, KEYS, "tick", "valid_from", "valid_to", size)
    return joined.select(*rows.columns, *STATE_COLUMNS)


def state_table(stored: DataFrame, config: DataFrame) -> DataFrame:
    """Stored state of every configured equipment; missing or unreadable means CALIBRATING."""
    return config.select("equipment_id").join(stored, KEYS, "left").select(
        "equipment_id", state_or_default(F.col("state")).alias("state")
    )


def model_compat(models: DataFrame, config: DataFrame) -> DataFrame:
    """Does a stored model fit the current settings? Window size and the set of tags must agree."""
    wanted = config.select("equipment_id", F.col("window_size").alias("want_window"), F.col("tags").alias("want_tags"))

    def as_set(name: str) -> Column:
        return F.array_sort(F.array_distinct(name))

    same_window = F.col("window_size") == F.col("want_window")
    same_tags = as_set("tags") == as_set("want_tags")
    reason = F.when(~same_window, "window_size differs").when(~same_tags, "tags differ")
    return models.join(wanted, KEYS).select(
        "equipment_id", "model_version", reason.isNull().alias("ok"), reason.alias("reason")
    )


def resume_or_fallback(stored: DataFrame, models: DataFrame, config: DataFrame) -> DataFrame:
    """State after a restart: MONITORING only with a stored, compatible newest model."""
    newest = models.groupBy("equipment_id").agg(
        F.max_by(F.struct("model_version", "window_size", "tags"), "model_version").alias("m")
    ).select("equipment_id", "m.*")
    checked = model_compat(newest, config)
    usable = (F.col("state") == "MONITORING") & F.coalesce("ok", F.lit(False))
    return state_table(stored, config).join(checked, KEYS, "left").select(
        "equipment_id",
        F.when(usable, "MONITORING").otherwise("CALIBRATING").alias("state"),
        F.when(usable, F.col("model_version")).alias("model_version"),
        F.when((F.col("state") == "MONITORING") & ~usable, F.coalesce("reason", F.lit("no stored model"))).alias("reason"),
    )
