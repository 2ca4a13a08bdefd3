"""Settings with a history: what a machine was configured with at each time, and what a change breaks.

A change of the tags, the window or the interval makes a stored model useless and ends the episode: its samples are cleared, nothing
seen before is held, and the machine is CALIBRATING again. The time between two such changes is an era. Each era runs
through the chain as a machine of its own, so no operator needs to know of settings that change. Other changes (sample
counts, retention, topics) leave the era alone and hold from the tick they fall in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions.scalars import tick_of
from millwatch.operators.snapshots import KEYS

#: What a command needs to know of the settings of its time.
TRAIN_SETTINGS = ("min_samples", "max_duration")


def settings_eras(history: DataFrame) -> DataFrame:
    """``history(equipment_id, valid_from, ...settings)`` with ``unit``, ``era``, ``cause``, and the times ``from_us`` (after) and ``to_us`` (up to) of each version.

    A null ``valid_from`` is the start of time. A version holds until the next one of its machine; of versions with one start the greatest stays.
    ``cause`` says what ended the era before, and is null inside an era. There are few versions per machine, so a window by machine is small.
    """
    columns = [c for c in history.columns if c not in ("equipment_id", "valid_from")]
    one = history.groupBy("equipment_id", "valid_from").agg(F.max(F.struct(*columns)).alias("s")).select("equipment_id", "valid_from", "s.*")
    log = W.partitionBy("equipment_id").orderBy(F.col("valid_from").asc_nulls_first())
    names = F.array_sort(F.array_distinct("tags"))

    def differs(value: Column) -> Column:
        return F.coalesce(F.lag(value).over(log) != value, F.lit(False))

    cause = (
        F.when(differs(F.col("window_size")), "window_size differs")
        .when(differs(names), "tags differ")
        .when(differs(F.col("resample_interval_ms")), "resample_interval_ms differs")
    )
    step = F.col("resample_interval_ms").cast("long") * 1000
    marked = one.withColumns({"cause": cause, "from_us": (tick_of(F.col("valid_from"), F.col("resample_interval_ms")) - 1) * step})
    marked = marked.withColumns(
        {
            "era": F.sum(F.col("cause").isNotNull().cast("long")).over(log.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "to_us": F.lead("from_us").over(log),
        }
    )
    return marked.withColumn("unit", F.concat(F.col("era").cast("string"), F.lit("|"), F.col("equipment_id")))


def unit_config(eras: DataFrame) -> DataFrame:
    """One row of settings per era, as a machine named ``unit``: those of its newest version, and ``until_tick``, the last tick before the era ended."""
    rows = eras.drop("equipment_id", "cause", "era", "from_us")
    columns = [c for c in rows.columns if c not in ("unit", "valid_from")]
    newest = rows.groupBy("unit").agg(
        F.max_by(F.struct(*columns), F.struct(F.col("valid_from").isNotNull(), "valid_from")).alias("s")
    )
    until = F.floor(F.col("to_us") / (F.col("resample_interval_ms").cast("long") * 1000))
    return newest.select(F.col("unit").alias("equipment_id"), "s.*").withColumn("until_tick", until).drop("to_us")


def by_era(rows: DataFrame, eras: DataFrame, at: str = "ts", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows under the name of the era they fall in, with the settings ``also`` of that time. Rows before a machine's first version are left out."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    spans = eras.select("equipment_id", "unit", "from_us", "to_us", *also)
    inside = (F.col("from_us").isNull() | (us > F.col("from_us"))) & (F.col("to_us").isNull() | (us <= F.col("to_us")))
    found = rows.drop(*also).join(spans, KEYS).filter(inside)
    return found.withColumn("equipment_id", F.col("unit")).drop("unit", "from_us", "to_us")


def split_unit(rows: DataFrame) -> DataFrame:
    """Rows of eras under their machine's own name again, with ``era``."""
    era = F.substring_index("equipment_id", "|", 1)
    machine = F.expr("substring(equipment_id, length(substring_index(equipment_id, '|', 1)) + 2)")
    others = [c for c in rows.columns if c != "equipment_id"]
    return rows.select(machine.alias("equipment_id"), era.cast("long").alias("era"), *others)


def clip_intervals(intervals: DataFrame, eras: DataFrame) -> DataFrame:
    """State intervals of eras, cut to the ticks of their era, with the ``cause`` that began it beside its first interval."""
    step = F.col("resample_interval_ms").cast("long") * 1000
    spans = eras.groupBy("unit").agg(
        F.min_by("cause", F.struct(F.col("valid_from").isNotNull(), "valid_from")).alias("cause"),
        F.min_by(F.floor(F.col("from_us") / step), F.struct(F.col("valid_from").isNotNull(), "valid_from")).alias("from_tick"),
        F.max_by(F.floor(F.col("to_us") / step), F.struct(F.col("valid_from").isNotNull(), "valid_from")).alias("to_tick"),
    )
    joined = intervals.join(spans.withColumnRenamed("unit", "equipment_id"), KEYS)
    first = F.col("valid_from").isNull()
    clipped = joined.withColumns(
        {
            "cause": F.when(first, F.col("cause")),
            "valid_from": F.coalesce("valid_from", F.col("from_tick") + 1),
            "valid_to": F.coalesce("valid_to", F.col("to_tick") + 1),
        }
    ).drop("from_tick", "to_tick")
    return split_unit(clipped)
