"""Inspection rows to per-minute failure features.

``label_inspections`` judges every row; the rest works on a gapless minute grid per series.
A minute is counted from the epoch, so a row's place in the grid is known without numbering.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions.scalars import (
    finite_or_null,
    floor_div,
    inspection_time,
    out_of_tolerance,
)
from millwatch.operators.buckets import BUCKET, BUCKET_TICKS, add_halo, bucket_spans, own_rows, spread
from millwatch.sources.inspections import MEASURE_PREFIXES

# Window lengths, target rule and averaging spans.
ROLLING_MINUTES = 30
TARGET_MINUTES = 60
TARGET_FAILURES = 4
EWMA_SPANS = (5, 30)
TEST_SHARE = 0.2
FEATURES = ("ng_sum_30", "ng_mean_30", "ng_std_30", "ng_max_30", "ng_slope_30", "ewma_gap")

EWMA_BLOCK = 256
EWMA_CUTOFF = 1e-18


def measure_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(MEASURE_PREFIXES)]


def inspection_timestamp(df: DataFrame) -> DataFrame:
    """Add ``inspected_at``; rows whose date or time cannot be read are dropped."""
    return df.withColumn("inspected_at", inspection_time(F.col("INSP_DATE"), F.col("INSP_TIME"))).filter(
        F.col("inspected_at").isNotNull()
    )


def scale_measures(df: DataFrame) -> DataFrame:
    """Scaled integers to units: every measure divided by 1000."""
    return df.withColumns(
        {c: finite_or_null(F.col(c).cast("double")) / F.lit(1000.0) for c in measure_columns(df)}
    )


def tolerance_judge(df: DataFrame) -> DataFrame:
    """Add ``is_ng`` from scaled measures. A column the input lacks counts as missing."""
    have = set(df.columns)

    def measure(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    return df.withColumn("is_ng", out_of_tolerance(measure))


def label_inspections(df: DataFrame) -> DataFrame:
    """Timestamp, scale and judge; one projection with one filter, no shuffle."""
    labelled = tolerance_judge(scale_measures(inspection_timestamp(df)))
    return labelled.withColumn("minute", floor_div(F.unix_seconds("inspected_at"), 60))


def minute_ng_count(labelled: DataFrame) -> DataFrame:
    """Failures per series and minute (only minutes that hold rows)."""
    return labelled.groupBy("series_id", "minute").agg(F.sum("is_ng").alias("ng"))


def minute_spans(labelled: DataFrame) -> DataFrame:
    """First and last minute of each series. Reads the time columns only."""
    return labelled.groupBy("series_id").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))


def minute_grid(
    counts: DataFrame, spans: DataFrame, size: int = BUCKET_TICKS, back: int = 0, ahead: int = 0
) -> DataFrame:
    """Every minute between a series' first and last, empty ones as 0, with a halo per bucket.

    Only non-empty minutes and one marker row per bucket are shuffled. Zeros are made after the
    shuffle, by stretching each row up to the next one in its bucket.
    """
    start = F.col(BUCKET) * size
    markers = bucket_spans(spans, ["series_id"], size).select(
        "series_id",
        BUCKET,
        F.greatest(F.col("lo"), start - back).alias("minute"),
        (F.least(F.col("hi"), start + size - 1 + ahead) + 1).alias("stop"),
        "lo",
        "hi",
    )
    points = add_halo(counts, "minute", size, back, ahead)
    w = W.partitionBy("series_id", BUCKET).orderBy(F.col("minute"), F.col("ng").asc_nulls_first())
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    until = F.coalesce(F.lead("minute").over(w), F.col("stop"))
    return (
        spread(markers.unionByName(points, allowMissingColumns=True), ["series_id"])
        .withColumns({c: F.first(c, ignorenulls=True).over(upto) for c in ("stop", "lo", "hi")})
        .withColumn("until", until)
        # A marker is followed at once by the real row of its own minute, if there is one.
        .filter(F.col("until") > F.col("minute"))
        .select(
            "series_id",
            BUCKET,
            "lo",
            "hi",
            F.col("minute").alias("held"),
            "ng",
            F.explode(F.sequence("minute", F.col("until") - 1)).alias("minute"),
        )
        .withColumn("ng", F.when(F.col("held") == F.col("minute"), F.coalesce("ng", F.lit(0))).otherwise(F.lit(0)))
        .drop("held")
    )


def gap_fill_minutes(labelled: DataFrame, size: int = BUCKET_TICKS) -> DataFrame:
    grid = minute_grid(minute_ng_count(labelled), minute_spans(labelled), size)
    return grid.select("series_id", "minute", "ng")


def _ordered(frame: tuple[int, int]) -> W:
    return W.partitionBy("series_id", BUCKET).orderBy("block", "minute").rowsBetween(*frame)


def add_running_sums(grid: DataFrame) -> DataFrame:
    """Sums over the last 30 minutes of y, y*y and x*y, from running totals.

    Counts are whole numbers, so a difference of two totals is exact, and a row costs the same
    whatever the window length. ``n`` is the number of minutes in the window.
    """
    upto = _ordered((W.unboundedPreceding, W.currentRow))
    at = W.partitionBy("series_id", BUCKET).orderBy("block", "minute")
    y = F.col("ng").cast("long")
    totals = {"_y": F.sum(y).over(upto), "_yy": F.sum(y * y).over(upto), "_xy": F.sum((F.col("minute") - F.col("lo")) * y).over(upto)}
    last_30 = {c: F.col(c) - F.coalesce(F.lag(c, ROLLING_MINUTES).over(at), F.lit(0)) for c in totals}
    n = F.least(F.lit(ROLLING_MINUTES), F.col("minute") - F.col("lo") + 1)
    return grid.withColumns(totals).withColumns({**last_30, "_n": n})


def rolling_columns() -> dict[str, Column]:
    """Sum, mean, sample deviation and maximum of the last 30 minutes, this one included."""
    n, y, yy = F.col("_n"), F.col("_y"), F.col("_yy")
    return {
        "ng_sum_30": y.cast("double"),
        "ng_mean_30": y / n,
        "ng_std_30": F.when(n > 1, F.sqrt((n * yy - y * y) / (n * (n - 1)))).otherwise(F.lit(0.0)),
        "ng_max_30": F.max("ng").over(_ordered((1 - ROLLING_MINUTES, 0))).cast("double"),
    }


def slope_columns() -> dict[str, Column]:
    """Least-squares slope per minute over the last 30 minutes (minutes are evenly spaced)."""
    n = F.col("_n")
    mean_x = F.col("minute") - F.col("lo") - (n - 1) / F.lit(2.0)
    spread_x = n * (n * n - 1) / F.lit(12.0)
    return {"ng_slope_30": F.when(n > 1, (F.col("_xy") - mean_x * F.col("_y")) / spread_x).otherwise(F.lit(0.0))}


def target_columns() -> dict[str, Column]:
    """1 when at least four failures fall in the next 60 minutes, this minute excluded."""
    w = _ordered((1, TARGET_MINUTES))
    hit = F.coalesce(F.sum("ng").over(w), F.lit(0)) >= TARGET_FAILURES
    return {
        "target": hit.cast("int"),
        "target_complete": F.col("minute") + TARGET_MINUTES <= F.col("hi"),
    }


def ewma_blocks(span: int) -> int:
    """How many earlier blocks still move an average of this span in double precision."""
    keep = 1.0 - 2.0 / (span + 1.0)
    return max(1, math.ceil(math.log(EWMA_CUTOFF) / (EWMA_BLOCK * math.log(keep))))


def add_ewma(grid: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Exponentially weighted means by name with a recursive start (the first value seeds them).

    The recursion becomes a weighted sum inside blocks of 256 minutes, where powers stay small,
    plus the decayed end values of the few earlier blocks that still matter. These lie inside
    the halo, so one partitioning and one sort serve every span and every other feature. All spans go through each of the
    two windows together.
    """
    pos = F.col("minute") - F.col("block") * EWMA_BLOCK
    block = W.partitionBy("series_id", BUCKET, "block").orderBy("minute")
    by_block = W.partitionBy("series_id", BUCKET).orderBy("block")
    inside, means = {}, {}
    for name, span in spans.items():
        alpha = 2.0 / (span + 1.0)
        keep, own = 1.0 - alpha, f"_inside{name}"
        weight = F.when(F.col("minute") == F.col("lo"), F.lit(1.0)).otherwise(F.lit(alpha))
        inside[own] = F.pow(F.lit(keep), pos) * F.sum(weight * F.col("ng") * F.pow(F.lit(keep), -pos)).over(
            block.rowsBetween(W.unboundedPreceding, W.currentRow)
        )
        ends = F.when(pos == EWMA_BLOCK - 1, F.col(own))
        carry = F.lit(0.0)
        for k in range(1, ewma_blocks(span) + 1):
            end = F.coalesce(F.sum(ends).over(by_block.rangeBetween(-k, -k)), F.lit(0.0))
            carry = carry + end * F.lit(keep ** (EWMA_BLOCK * (k - 1)))
        means[name] = F.col(own) + F.pow(F.lit(keep), pos + 1) * carry
    return grid.withColumns(inside).withColumns(means).drop(*inside)


def with_features(grid: DataFrame, spans: tuple[int, int] = EWMA_SPANS) -> DataFrame:
    """All six features and the target on a haloed grid; one exchange and one sort."""
    df = grid.withColumn("block", floor_div(F.col("minute"), EWMA_BLOCK))
    df = add_running_sums(df).withColumns({**rolling_columns(), **slope_columns(), **target_columns()})
    df = add_ewma(df, {"_fast": spans[0], "_slow": spans[1]})
    return df.withColumn("ewma_gap", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", "block", "_n", "_y", "_yy", "_xy")


def ewma_halo() -> int:
    return max(ewma_blocks(s) for s in EWMA_SPANS) * EWMA_BLOCK


def ml_feature_table(
    labelled: DataFrame, size: int = BUCKET_TICKS, drop_incomplete_target: bool = False
) -> DataFrame:
    """Per-minute features, target and chronological part (``train`` or ``test``).

    ``drop_incomplete_target`` leaves out the last minutes of a series, whose target sees a
    shortened future.
    """
    if size % EWMA_BLOCK:
        raise ValueError(f"bucket size must be a multiple of {EWMA_BLOCK}")
    grid = minute_grid(minute_ng_count(labelled), minute_spans(labelled), size, ewma_halo(), TARGET_MINUTES)
    rows = own_rows(with_features(grid), "minute", size).drop(BUCKET)
    if drop_incomplete_target:
        rows = rows.filter("target_complete").withColumn("hi", F.col("hi") - TARGET_MINUTES)
    return chrono_split(rows)


def chrono_split(rows: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Mark the last fifth of each series as ``test``.

    The grid has no gaps, so a row's rank is plain arithmetic on its minute.
    """
    n = F.col("hi") - F.col("lo") + 1
    held_out = F.ceil(n * F.lit(test_share))
    in_train = F.col("minute") - F.col("lo") + 1 <= n - held_out
    return rows.withColumn("part", F.when(in_train, "train").otherwise("test"))


def class_weight(rows: DataFrame) -> DataFrame:
    """Negatives over positives of the training part, 1 when there is no positive."""
    train = F.col("part") == "train"
    pos = F.count_if(train & (F.col("target") == 1))
    neg = F.count_if(train & (F.col("target") == 0))
    return rows.agg(
        neg.alias("negatives"),
        pos.alias("positives"),
        F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("scale_pos_weight"),
    )
