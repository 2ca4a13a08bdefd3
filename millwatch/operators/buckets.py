"""Exact ordered work on long series, split into bounded buckets.

A window partitioned by a series alone puts the whole series into one task. Everything
here partitions by ``(series, bucket)`` instead, where a bucket is ``size`` consecutive
ticks. Neighbouring rows come from a halo (bounded frames) or from one carried value per
bucket (unbounded frames). A bucket holds at most ``size`` ticks however many rows the
series has, and tables with one row per bucket have a length set by the calendar span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions.scalars import floor_div

BUCKET = "bucket"
BUCKET_TICKS = 4096


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lay rows out by (key, bucket).

    Spark accepts rows already hashed by the key alone, e.g. after a shuffle join, as good enough
    for a window over (key, bucket). That would put a whole series into one task again, so the
    layout is stated wherever a bucketed window starts.
    """
    return df.repartition(*keys, BUCKET)


def add_bucket(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn(BUCKET, floor_div(F.col(index), size))


def add_halo(df: DataFrame, index: str, size: int, back: int | Column = 0, ahead: int | Column = 0) -> DataFrame:
    """Copy each row into every bucket whose own rows look at it.

    An own row sees ``back`` ticks before it and ``ahead`` ticks after it, so with a bucket
    larger than both, only rows near a border are copied. Both may differ between series.
    """
    i = F.col(index)
    targets = F.sequence(floor_div(i - ahead, size), floor_div(i + back, size))
    return df.withColumn(BUCKET, F.explode(targets))


def own_rows(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.filter(floor_div(F.col(index), size) == F.col(BUCKET))


def bucket_spans(spans: DataFrame, keys: Sequence[str], size: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row per bucket touched by each ``[lo, hi]`` span."""
    buckets = F.sequence(floor_div(F.col(lo), size), floor_div(F.col(hi), size))
    return spans.select(*keys, lo, hi, F.explode(buckets).alias(BUCKET))


def carried_in(
    points: DataFrame, buckets: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """For each listed bucket, the last non-null ``values`` of ``points`` in any earlier bucket.

    ``points`` is reduced to one row per bucket before the running ``last``.
    """
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    last_in_bucket = [F.max_by(v, F.when(F.col(v).isNotNull(), by)).alias(v) for v in values]
    marked = (
        points.groupBy(*keys, BUCKET)
        .agg(*last_in_bucket)
        .unionByName(buckets.select(*keys, BUCKET, F.lit(True).alias("listed")), allowMissingColumns=True)
    )
    # A listed bucket sorts before the points of the same bucket, so it sees earlier ones only.
    w = W.partitionBy(*keys).orderBy(BUCKET, F.col("listed").desc_nulls_last())
    earlier = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumns({v: F.last(v, ignorenulls=True).over(earlier) for v in values}).filter("listed").drop("listed")


def asof_last(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    tick: str,
    values: Sequence[str],
    size: int = BUCKET_TICKS,
    inclusive: bool = True,
) -> DataFrame:
    """Attach to each probe the latest non-null ``values`` at or before it (strictly before if
    not inclusive). Points are unique per tick, or a tick's points agree.

    Made for few probes over many points: points shrink to one row per bucket before a shuffle,
    and only points of buckets that hold a probe are shuffled as rows. The value from earlier
    buckets comes as one extra row per bucket. Both sides need ``keys`` and ``tick``.
    """
    p = add_bucket(points.select(*keys, tick, *values), tick, size)
    q = add_bucket(probes.select(*keys, tick, F.struct(*probes.columns).alias("probe")), tick, size)
    asked = q.select(*keys, BUCKET).distinct()
    seeds = carried_in(p, asked, keys, [tick], values)
    p = p.join(asked, [*keys, BUCKET], "left_semi")
    point_kind, probe_kind = (1, 2) if inclusive else (2, 1)
    rows = spread(
        seeds.withColumns({tick: F.lit(None).cast("long"), "kind": F.lit(0)})
        .unionByName(p.withColumn("kind", F.lit(point_kind)))
        .unionByName(q.withColumn("kind", F.lit(probe_kind)), allowMissingColumns=True),
        keys,
    )
    w = W.partitionBy(*keys, BUCKET).orderBy(F.col(tick).asc_nulls_first(), "kind")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values})
        .filter(F.col("probe").isNotNull())
        .select("probe.*", *values)
    )


def within_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    tick: str,
    lo: str,
    hi: str,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Join each row to the interval of its key with ``lo <= tick < hi``; a null bound is open.

    Made for many rows and few intervals: intervals are cut at bucket borders, so the join is on
    (key, bucket). Rows stay in place when the cut intervals fit a broadcast, and spread by bucket
    when they do not.
    """
    spans = rows.groupBy(*keys).agg(F.min(tick).alias("_first"), F.max(tick).alias("_last"))
    cut = (
        intervals.join(spans, list(keys))
        .withColumn("_from", F.greatest(F.coalesce(lo, "_first"), "_first"))
        .withColumn("_to", F.least(F.coalesce(F.col(hi) - 1, F.col("_last")), "_last"))
        .filter(F.col("_from") <= F.col("_to"))
        .drop("_first", "_last", lo, hi)
        .withColumn(BUCKET, F.explode(F.sequence(floor_div(F.col("_from"), size), floor_div(F.col("_to"), size))))
    )
    return (
        add_bucket(rows, tick, size)
        .join(cut, [*keys, BUCKET])
        .filter(F.col(tick).between(F.col("_from"), F.col("_to")))
        .drop(BUCKET, "_from", "_to")
    )


def add_sequence(
    df: DataFrame, keys: Sequence[str], tick: str, size: int = BUCKET_TICKS, name: str = "seq"
) -> DataFrame:
    """Number the rows of each series 0, 1, 2, … in tick order (one row per tick).

    Row numbers are local to a bucket; a bucket starts at the row count of the buckets before it.
    Rows that carry a bucket are taken to be laid out by it.
    """
    bucketed = df if BUCKET in df.columns else spread(add_bucket(df, tick, size), keys)
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, BUCKET, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    inside = W.partitionBy(*keys, BUCKET).orderBy(tick)
    return (
        bucketed.withColumn("place", F.row_number().over(inside))
        .join(starts, [*keys, BUCKET])
        .withColumn(name, F.col("start") + F.col("place") - 1)
        .drop("start", "place")
    )


def add_run_length(
    df: DataFrame, keys: Sequence[str], tick: str, hit: Column, size: int = BUCKET_TICKS, name: str = "run"
) -> DataFrame:
    """Length of the unbroken run of ``hit`` rows that ends at each row.

    Inside a bucket this is the distance to the last miss. A bucket that starts mid-run adds
    the run carried in: rows since the last miss in earlier buckets, summed from one row per bucket.
    """
    inside = W.partitionBy(*keys, BUCKET).orderBy(tick)
    rows = (
        spread(add_bucket(df, tick, size), keys)
        .withColumn("place", F.row_number().over(inside))
        .withColumn("miss", F.when(~hit | hit.isNull(), F.col("place")))
        .withColumn("miss", F.last("miss", ignorenulls=True).over(inside))
    )
    tails = rows.groupBy(*keys, BUCKET).agg(F.max("place").alias("n"), F.max("miss").alias("miss"))
    upto = W.partitionBy(*keys).orderBy(BUCKET)
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    carried = (
        tails.withColumn("seen", F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("last_miss", F.when(F.col("miss").isNotNull(), F.col("seen") - F.col("n") + F.col("miss")))
        .select(
            *keys,
            BUCKET,
            (
                F.col("seen") - F.col("n") - F.coalesce(F.last("last_miss", ignorenulls=True).over(before), F.lit(0))
            ).alias("carry"),
        )
    )
    run = F.when(F.col("miss").isNull(), F.col("place") + F.col("carry")).otherwise(F.col("place") - F.col("miss"))
    return rows.join(carried, [*keys, BUCKET]).withColumn(name, run).drop("place", "miss", "carry", BUCKET)
