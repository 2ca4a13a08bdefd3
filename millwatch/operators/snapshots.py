"""Readings to snapshots, and snapshots to sliding windows.

A snapshot is one row per equipment and tick: ``values`` holds the latest value of every
configured tag, in config order. The chain shuffles twice: change points by
(equipment, bucket of ticks), and snapshots by (equipment, bucket of snapshot numbers).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions.scalars import finite_or_null, floor_div, tick_of
from millwatch.operators.buckets import (
    BUCKET,
    BUCKET_TICKS,
    add_bucket,
    add_halo,
    add_sequence,
    own_rows,
    spread,
)

KEYS = ["equipment_id"]


def arrival_order(readings: DataFrame, ts: Column, ord_: Column) -> Column:
    """Sort key by time, then arrival. A whole-number ``ord`` is packed with the time into one
    decimal, which keeps the aggregation below hash-based; a struct key would make it sort."""
    if dict(readings.dtypes)["ord"] not in ("bigint", "int"):
        return F.struct(ts.alias("ts"), ord_.alias("ord"))
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10) ** 19) + ord_.cast("decimal(19,0)")


def change_points(readings: DataFrame, config: DataFrame) -> DataFrame:
    """Last reading of each tag in each tick: ``(equipment_id, pos, tick, value, at)``.

    A row with a null value is an explicit null: it overwrites the value before it. Reduced
    before the shuffle, so a tick that receives very many readings still sends one row per task.
    """
    return last_points(placed_readings(readings, config))


def placed_readings(readings: DataFrame, config: DataFrame) -> DataFrame:
    """Every reading of a configured tag with its position and tick, in the columns of ``change_points``."""
    tags = config.select("equipment_id", "resample_interval_ms", F.posexplode("tags").alias("pos", "tag"))
    return readings.join(tags, ["equipment_id", "tag"]).select(
        "equipment_id",
        "pos",
        tick_of(F.col("ts"), F.col("resample_interval_ms")).alias("tick"),
        finite_or_null(F.col("value")).alias("value"),
        arrival_order(readings, F.col("ts"), F.col("ord")).alias("at"),
    )


def last_points(points: DataFrame) -> DataFrame:
    """The newest of the points of each tag in each tick."""
    return points.groupBy("equipment_id", "pos", "tick").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def bucket_seeds(points: DataFrame, config: DataFrame, size: int, until: Column | None = None) -> DataFrame:
    """One row per equipment, tag and bucket of its tick range, with the value carried in.

    ``points`` shrinks to one row per tag and bucket; everything after works on that small
    table, and no window is wider than one tag of one equipment. A row's value reaches all buckets up to and including the tag's next row, and a row
    placed before the first bucket stands for "nothing seen yet".
    """
    per_bucket = points.groupBy("equipment_id", "pos", BUCKET).agg(
        F.min("tick").alias("lo"), F.max("tick").alias("hi"), F.max_by("value", "tick").alias("value")
    )
    # Asking for the values too keeps this branch equal to the one above up to its exchange, which Spark then
    # uses twice; without it the readings would be read once more.
    span = per_bucket.groupBy("equipment_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("value").alias("seen")
    )
    end = F.lit(None).cast("long") if until is None else until.cast("long")
    unseen = config.select("equipment_id", end.alias("end"), F.posexplode("tags").alias("pos", "tag"))
    # The span comes first, so that a filter on the equipment goes down to the readings.
    unseen = span.filter("seen >= 0").join(unseen, KEYS).select(
        "equipment_id", "pos", F.col("lo").alias("first"), F.greatest("hi", "end").alias("final")
    )
    whole = W.partitionBy("equipment_id", "pos")
    tag = whole.orderBy(BUCKET)
    return (
        per_bucket.drop("lo", "hi")
        .unionByName(unseen, allowMissingColumns=True)
        .withColumns({"lo": F.max("first").over(whole), "hi": F.max("final").over(whole)})
        .withColumn(BUCKET, F.coalesce(BUCKET, floor_div(F.col("lo"), size) - 1))
        .withColumn("last", F.coalesce(F.lead(BUCKET).over(tag), floor_div(F.col("hi"), size)))
        .filter(F.col("last") > F.col(BUCKET))
        .select(
            "equipment_id", "pos", "lo", "hi", "value", F.explode(F.sequence(F.col(BUCKET) + 1, "last")).alias(BUCKET)
        )
        .select(
            "equipment_id",
            "pos",
            BUCKET,
            F.greatest(F.col("lo"), F.col(BUCKET) * size).alias("tick"),
            (F.least(F.col("hi"), F.col(BUCKET) * size + size - 1) + 1).alias("stop"),
            "value",
        )
    )


def asof_snapshot(
    readings: DataFrame,
    config: DataFrame,
    size: int = BUCKET_TICKS,
    until: Column | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """``(equipment_id, bucket, tick, values)`` for every tick from the first reading on.

    Values are held until the next reading, also over buckets without any: each bucket of each
    tag starts with one row that carries the value in. Only change points and these rows are
    shuffled; the dense grid is made after the shuffle and stays in its task until it is one
    row per tick. The grid ends at the equipment's last reading, or at tick ``until`` (an expression
    over the config) if that is later.
    """
    return snapshot_grid(change_points(readings, config).drop("at"), config, size, until, keep_empty)


def snapshot_grid(
    points: DataFrame,
    config: DataFrame,
    size: int = BUCKET_TICKS,
    until: Column | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Snapshots from change points, see ``asof_snapshot``."""
    points = add_bucket(points, "tick", size)
    seeds = bucket_seeds(points, config, size, until).withColumn("kind", F.lit(0))
    rows = seeds.unionByName(points.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("equipment_id", BUCKET, "pos").orderBy("tick", "kind")
    held = (
        spread(rows, KEYS)
        .withColumn("stop", F.first("stop", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("next", F.coalesce(F.lead("tick").over(w), F.col("stop")))
        # A seed is followed at once by the reading of its own tick, if there is one.
        .filter(F.col("next") > F.col("tick"))
        .select(
            "equipment_id", BUCKET, "pos", "value", F.explode(F.sequence("tick", F.col("next") - 1)).alias("tick")
        )
    )
    snapshots = (
        held.groupBy("equipment_id", BUCKET, "tick")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select("equipment_id", BUCKET, "tick", F.col("cells.value").alias("values"))
    )
    return snapshots if keep_empty else drop_empty_snapshot(snapshots)


def drop_empty_snapshot(snapshots: DataFrame) -> DataFrame:
    """Leave out ticks at which every tag is missing."""
    return snapshots.filter(F.exists("values", lambda v: v.isNotNull()))


def long_form(snapshots: DataFrame, config: DataFrame, value: str = "values") -> DataFrame:
    """One row per tag: ``(equipment_id, tick, tag, value)``."""
    return (
        snapshots.join(config.select("equipment_id", "tags"), KEYS)
        .select("equipment_id", "tick", F.posexplode(value).alias("pos", "value"), "tags")
        .select("equipment_id", "tick", F.get("tags", F.col("pos")).alias("tag"), "value")
    )


def number_snapshots(snapshots: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Add ``seq``: a snapshot's number within its equipment. Dropped ticks leave no hole."""
    return add_sequence(snapshots, KEYS, "tick", size).drop(BUCKET)


def complete(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull())


def with_window_state(numbered: DataFrame, config: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """Add ``prev`` (the snapshot before), ``window_size`` and ``usable``.

    A tick is usable when it and the ``window_size`` snapshots before it exist and miss no value.
    A halo of the equipment's own ``window_size`` rows makes this local to a bucket; a window may be longer than one.
    """
    return _window_columns(numbered, config, size, lambda w: {"prev": F.lag("values").over(w)})


def sliding_windows(numbered: DataFrame, config: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    """``history`` (the ``window_size`` snapshots before a tick, oldest first) and ``target``."""
    longest = config.agg(F.max("window_size")).first()[0] or 1
    frame = (-longest, -1)
    rows = _window_columns(
        numbered, config, size, lambda w: {"before": F.collect_list("values").over(w.rowsBetween(*frame))}
    )
    history = F.slice("before", -F.col("window_size"), F.col("window_size"))
    return rows.filter("usable").select(
        "equipment_id", "tick", "seq", history.alias("history"), F.col("values").alias("target")
    )


def _window_columns(numbered: DataFrame, config: DataFrame, size: int, extra) -> DataFrame:
    w = W.partitionBy("equipment_id", BUCKET).orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.last(F.when(~complete(F.col("values")), F.col("seq")), ignorenulls=True).over(upto)
    before = F.greatest(F.coalesce(gap, F.lit(-1)), F.col(BUCKET) * size - F.col("window_size") - 1, F.lit(-1))
    sized = numbered.join(config.select("equipment_id", "window_size"), KEYS)
    rows = spread(add_halo(sized, "seq", size, back=F.col("window_size")), KEYS)
    rows = rows.withColumns({"usable": F.col("seq") - before > F.col("window_size"), **extra(w)})
    return own_rows(rows, "seq", size).drop(BUCKET)


def recent_n(snapshots: DataFrame, n: int, size: int = BUCKET_TICKS) -> DataFrame:
    """The newest ``n`` snapshots of each equipment.

    Row counts per bucket tell which buckets can matter, so the ranking sorts fewer than
    ``n + size`` rows per equipment, however long its history.
    """
    rows = snapshots if BUCKET in snapshots.columns else spread(add_bucket(snapshots, "tick", size), KEYS)
    newer = W.partitionBy("equipment_id").orderBy(F.desc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    useful = (
        rows.groupBy("equipment_id", BUCKET)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        .filter(F.col("newer") < n)
        .select("equipment_id", BUCKET, "newer")
    )
    inside = W.partitionBy("equipment_id", BUCKET).orderBy(F.desc("tick"))
    return (
        rows.join(useful, ["equipment_id", BUCKET])
        .withColumn("place", F.row_number().over(inside) + F.col("newer"))
        .filter(F.col("place") <= n)
        .drop("place", "newer", BUCKET)
    )
