"""Continuous minute features: counts of finished minutes, then the batch features on a short tail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators.buckets import BUCKET_TICKS, own_rows, spread
from millwatch.operators.inspection import (
    EWMA_BLOCK,
    FEATURES,
    ewma_halo,
    minute_grid,
    with_features,
)
from millwatch.operators.risk import RiskModel, risk_score
from millwatch.session import stage
from millwatch.streaming.state import BatchTables

RISK_SCHEMA = "series_id STRING, minute BIGINT, risk DOUBLE, alarm BOOLEAN"
TAIL_SCHEMA = "series_id STRING, minute BIGINT, ng BIGINT, first BIGINT"
FEATURE_SCHEMA = "series_id STRING, minute BIGINT, ng BIGINT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)


OPEN_SCHEMA = "series_id STRING, minute BIGINT, ng BIGINT, newest_ms BIGINT"
WATERMARK_SCHEMA = "passed_ms BIGINT"


def finished_minutes(labelled: DataFrame, tables: BatchTables, batch: int, delay: str) -> DataFrame:
    """Failures per series and minute that the stream's newest ``inspected_at`` has passed by ``delay`` with this batch.

    Rows of minutes that were finished before the batch come too late and are dropped. Only the minutes still open are kept
    for the next batch, as a table; a batch's own minutes pass through no state, however many they are.
    """
    minute = F.floor(F.unix_seconds("inspected_at") / F.lit(60))
    counts = labelled.filter("inspected_at IS NOT NULL").groupBy("series_id", minute.alias("minute")).agg(
        F.sum("is_ng").cast("long").alias("ng"), F.max(F.unix_millis("inspected_at")).alias("newest_ms")
    )
    before = tables.read("watermark", batch - 1, WATERMARK_SCHEMA).first()
    before = before["passed_ms"] if before else None
    ends = (F.col("minute") + 1) * 60_000
    arrived = counts if before is None else counts.filter(ends > before)
    rows = arrived.unionByName(tables.read("open", batch - 1, OPEN_SCHEMA))
    rows = rows.groupBy("series_id", "minute").agg(F.sum("ng").alias("ng"), F.max("newest_ms").alias("newest_ms"))
    rows = tables.write_state(rows, "counts", batch)
    wait = F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{delay}'"))
    passed = rows.agg((F.max("newest_ms") - wait).alias("passed_ms")).select(F.greatest("passed_ms", F.lit(before).cast("long")).alias("passed_ms"))
    passed = tables.write_state(passed, "watermark", batch).first()["passed_ms"]
    done = F.coalesce(ends <= F.lit(passed).cast("long"), F.lit(False))
    tables.write_state(rows.filter(~done), "open", batch)
    return rows.filter(done).select("series_id", "minute", "ng")


def feature_step(counts: DataFrame, tables: BatchTables, batch: int, size: int = BUCKET_TICKS) -> DataFrame:
    """Features of the newly finished minutes, empty minutes in between included.

    The tail covers every minute that still moves a feature in double precision. Its first row
    may start inside an averaging block, so one extra block is kept.
    """
    tail = tables.read("tail", batch - 1, TAIL_SCHEMA)
    known = tail.groupBy("series_id").agg(F.max("minute").alias("done"), F.min("first").alias("first"))
    new = counts.select("series_id", "minute", F.col("ng").cast("long").alias("ng"))
    rows = tail.drop("first").unionByName(new)
    spans = rows.groupBy("series_id").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    grid = minute_grid(rows, spans, size, back=ewma_halo()).join(known, "series_id", "left")
    # The series' true first minute seeds the averages.
    grid = spread(grid, ["series_id"])
    grid = grid.withColumn("lo", F.coalesce("first", "lo"))
    featured = own_rows(with_features(grid), "minute", size)
    done = F.coalesce("done", F.lit(-(2**52)))
    columns = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]
    emitted = tables.write(
        featured.withColumn("ng", F.col("ng").cast("long")).filter(F.col("minute") > done).select(*columns, F.col("lo").alias("first")),
        "features",
        batch,
    )
    reach = ewma_halo() + EWMA_BLOCK
    ends = spans.select("series_id", (F.col("hi") - reach).alias("from"))
    kept = tail.unionByName(emitted.select("series_id", "minute", "ng", "first")).join(ends, "series_id")
    tables.write_state(kept.filter(F.col("minute") > F.col("from")).drop("from"), "tail", batch)
    return emitted.drop("first")


CHANGE_SCHEMA = FEATURE_SCHEMA + ", revision INT"
LATE_SCHEMA = "series_id STRING, minute BIGINT, ng BIGINT"


def change_step(labelled: DataFrame, tables: BatchTables, batch: int, horizon: int, size: int = BUCKET_TICKS) -> DataFrame:
    """Features of every minute that the new inspections change, as replacements of what was given out before.

    An inspection that comes late changes its own minute and all later ones that look back on it, so the minutes from the earliest
    touched one on are computed anew and given out with ``revision``, the batch number. ``horizon`` is how many minutes before its
    series' newest one an inspection may lie; a later one goes to the ``late`` table with what it would have added, and changes nothing.
    The state is what the batch before merged, of which the counts of the minutes that may change still and of those that move
    their features are read.
    """
    minute = F.floor(F.unix_seconds("inspected_at") / F.lit(60))
    counts = labelled.withColumn("minute", minute).groupBy("series_id", "minute").agg(F.sum("is_ng").cast("long").alias("ng"))
    state = tables.read("merged", batch - 1, TAIL_SCHEMA)
    known = state.groupBy("series_id").agg(F.max("minute").alias("was"), F.min("first").alias("was_first"))
    known = tables.write_state(known, "known", batch)
    reach = horizon + ewma_halo() + EWMA_BLOCK
    state = state.join(known, "series_id").filter(F.col("minute") > F.col("was") - reach)
    # The watermark of a series moves between batches only, so the order of rows within one does not matter.
    marked = tables.write_state(counts.filter("series_id IS NOT NULL AND minute IS NOT NULL").join(known, "series_id", "left"), "touched", batch)
    late = F.coalesce(F.col("minute") <= F.col("was") - horizon, F.lit(False))
    tables.write(marked.filter(late).select("series_id", "minute", "ng"), "late", batch)
    new = marked.filter(~late)
    touched = new.groupBy("series_id").agg(
        F.min("minute").alias("from"), F.least(F.min("minute"), F.min("was_first")).alias("first")
    )
    merged = state.select("series_id", "minute", "ng").unionByName(new.select("series_id", "minute", "ng"))
    merged = merged.groupBy("series_id", "minute").agg(F.sum("ng").alias("ng"))
    old = known.select("series_id", F.col("was_first"))
    firsts = touched.join(old, "series_id", "full").select("series_id", "from", F.coalesce("first", "was_first").alias("first"))
    merged = tables.write_state(merged.join(firsts, "series_id"), "merged", batch)
    rows = merged.filter(F.col("from").isNotNull())
    spans = rows.groupBy("series_id").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    grid = minute_grid(rows.select("series_id", "minute", "ng"), spans, size, back=ewma_halo()).join(touched, "series_id")
    grid = spread(grid, ["series_id"]).withColumn("lo", F.col("first"))
    featured = own_rows(with_features(grid), "minute", size).filter(F.col("minute") >= F.col("from"))
    columns = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]
    emitted = tables.write(
        featured.withColumn("ng", F.col("ng").cast("long")).select(*columns, F.lit(batch).alias("revision")), "changes", batch
    )
    return emitted


def latest_features(tables: BatchTables) -> DataFrame:
    """The features that hold after all batches so far: of each minute the newest revision.

    A revision gives out every minute of its series from its first one on, so a row holds unless a later revision of its series
    starts at or before its minute. Only one row per series and revision is compared; the features stay where they are.
    """
    rows = tables.all_batches("changes", CHANGE_SCHEMA)
    later = W.partitionBy("series_id").orderBy(F.desc("revision")).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("series_id", "revision").agg(F.min("minute").alias("start"))
    replaced = stage(starts.withColumn("replaced", F.min("start").over(later)).filter("replaced IS NOT NULL").drop("start"), "revisions")
    held = rows.join(replaced, ["series_id", "revision"], "left")
    return held.filter(F.col("replaced").isNull() | (F.col("minute") < F.col("replaced"))).select(*rows.columns)


def stream_minute_changes(
    labelled: DataFrame,
    root: str,
    horizon: int,
    on_changes: Callable[[DataFrame, BatchTables, int], object] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the feature stream with corrections: minutes are given out at once and replaced when late inspections arrive, see ``change_step``."""

    def step(rows: DataFrame, batch: int) -> None:
        tables = BatchTables(rows.sparkSession, root)
        emitted = change_step(rows, tables, batch, horizon)
        if on_changes is not None:
            on_changes(emitted, tables, batch)

    return labelled.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(**trigger).start()


def risk_step(model: RiskModel) -> Callable[[DataFrame, BatchTables, int], DataFrame]:
    """For ``on_features``: risk and alarm of the newly finished minutes, written as the ``risk`` table."""

    def step(features: DataFrame, tables: BatchTables, batch: int) -> DataFrame:
        scored = risk_score(model, features)
        return tables.write(scored.select("series_id", "minute", "risk", "alarm"), "risk", batch)

    return step


def stream_minute_features(
    labelled: DataFrame,
    root: str,
    delay: str,
    on_features: Callable[[DataFrame, BatchTables, int], object] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the feature stream; ``on_features`` can apply a risk model to each batch, see ``risk_step``.

    ``delay`` is how long a minute waits for rows that are out of order.
    """

    def step(rows: DataFrame, batch: int) -> None:
        tables = BatchTables(rows.sparkSession, root)
        emitted = feature_step(finished_minutes(rows, tables, batch, delay), tables, batch)
        if on_features is not None:
            on_features(emitted, tables, batch)

    return labelled.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/offsets").trigger(**trigger).start()
