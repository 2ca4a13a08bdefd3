"""Tag types, normalisation, the next-step forecaster and its normal error.

A model is one row per (equipment, version) with arrays in config tag order, so scoring is a
join and array arithmetic. Fitting explodes snapshots to (tag position, value, previous value)
and aggregates; partial aggregates leave one row per task and tag before the shuffle.

The forecaster predicts each tag's normalised next value as ``offset + slope * current``, by
least squares. On a 0/1 tag this line equals the two conditional frequencies P(1|0), P(1|1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.functions.scalars import floored_std
from millwatch.operators.snapshots import KEYS

VERSION = ["equipment_id", "model_version"]


def observations(rows: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """One row per snapshot and tag position."""
    return rows.select(*keys, *extra, F.posexplode("values").alias("pos", "value"))


def _is_binary(value: Column, when: Column | None = None) -> Column:
    v = value if when is None else F.when(when, value)
    low, high = F.min(v), F.max(v)
    only_bits = F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False))
    return F.coalesce((low != high) & only_bits, F.lit(False))


def tag_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per tag position: type, count, mean and population deviation of its observed values.

    A tag is binary when it took both 0 and 1 and nothing else; a constant tag is continuous.
    """
    v = F.col("value")
    std = F.stddev_pop(v)
    return observations(rows, keys).groupBy(*keys, "pos").agg(
        F.when(_is_binary(v), "binary").otherwise("continuous").alias("tag_type"),
        F.count(v).alias("n_observed"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"),
    )


def detect_tag_types(rows: DataFrame, config: DataFrame) -> DataFrame:
    return with_tag_names(tag_statistics(rows, KEYS), config).select("equipment_id", "tag", "tag_type")


def normalization_stats(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Mean and deviation of continuous tags; binary tags have none."""
    stats = with_tag_names(tag_statistics(rows, KEYS), config)
    return stats.filter(F.col("tag_type") == "continuous").select("equipment_id", "tag", "mean", "std")


def never_observed_tags(rows: DataFrame, config: DataFrame) -> DataFrame:
    stats = with_tag_names(tag_statistics(rows, KEYS), config)
    return stats.filter(F.col("n_observed") == 0).select("equipment_id", "tag")


def with_tag_names(by_position: DataFrame, config: DataFrame) -> DataFrame:
    return by_position.join(config.select("equipment_id", "tags"), KEYS).withColumn(
        "tag", F.get("tags", F.col("pos"))
    ).drop("tags")


def dtype_partition(types: DataFrame, config: DataFrame) -> DataFrame:
    """Config positions of each equipment's continuous and binary tags, in config order."""
    tags = config.select("equipment_id", F.posexplode("tags").alias("pos", "tag"))
    typed = tags.join(types, ["equipment_id", "tag"])

    def positions(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("tag_type") == kind, F.col("pos"))))

    return typed.groupBy("equipment_id").agg(
        positions("continuous").alias("continuous"), positions("binary").alias("binary")
    )


def fit_forecaster(training: DataFrame, keys: list[str] = VERSION) -> DataFrame:
    """Per (version, tag position): type, normalisation and forecast line, in one aggregation.

    ``training`` needs ``values``, ``prev`` and ``fit`` (true where the tick ends a full window).
    Types and normalisation use every training snapshot, the line only usable windows.
    """
    # The very first snapshot has no predecessor but still counts for types and normalisation.
    prev = F.coalesce("prev", F.array().cast("array<double>"))
    cells = training.select(
        *keys, "fit", F.posexplode(F.arrays_zip(F.col("values").alias("y"), prev.alias("x"))).alias("pos", "c")
    ).select(
        *keys,
        "pos",
        F.col("c.y").alias("value"),
        F.when(F.col("fit"), F.col("c.y")).alias("y"),
        F.when(F.col("fit"), F.col("c.x")).alias("x"),
    )
    v, y, x = F.col("value"), F.col("y"), F.col("x")
    std = F.stddev_pop(v)
    stats = cells.groupBy(*keys, "pos").agg(
        F.when(_is_binary(v), "binary").otherwise("continuous").alias("tag_type"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"),
        F.count(v).alias("n_observed"),
        F.count(y).alias("n_windows"),
        F.regr_slope(y, x).alias("slope"),
        F.avg(y).alias("mean_y"),
        F.avg(x).alias("mean_x"),
    )
    binary = F.col("tag_type") == "binary"
    # A tag that never moved has no slope: it is forecast by its mean.
    slope = F.coalesce(F.when(~F.isnan("slope"), F.col("slope")), F.lit(0.0))
    shift = F.when(binary, F.lit(0.0)).otherwise(F.col("mean"))
    scale = F.when(binary, F.lit(1.0)).otherwise(F.col("std"))
    return stats.select(
        *keys,
        "pos",
        "tag_type",
        "n_observed",
        "n_windows",
        shift.alias("norm_mean"),
        scale.alias("norm_std"),
        slope.alias("slope"),
        (((F.col("mean_y") - shift) - slope * (F.col("mean_x") - shift)) / scale).alias("offset"),
    )


PARAMETERS = ("tag_type", "norm_mean", "norm_std", "slope", "offset")


def pack_model(by_position: DataFrame, columns: tuple[str, ...] = PARAMETERS, keys: list[str] = VERSION) -> DataFrame:
    """Fold per-position rows into arrays in config order: one row per model."""
    cells = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    packed = by_position.groupBy(*keys).agg(cells.alias("cells"))
    return packed.select(*keys, *[F.col(f"cells.{c}").alias(c) for c in columns])


def align_models(models: DataFrame, config: DataFrame) -> DataFrame:
    """Models with every per-tag array in the order of today's config; incompatible ones are left out.

    A model fits if its window size and its set of tags are those of the config. Which tag an array
    element belongs to is decided by name, never by position.
    """
    wanted = config.select("equipment_id", F.col("tags").alias("want_tags"), F.col("window_size").alias("want_window"))
    place = F.transform("want_tags", lambda t: F.array_position("tags", t).cast("int") - 1)

    def ordered(name: str) -> Column:
        return F.transform("place", lambda i: F.get(name, i))

    same_tags = F.array_sort(F.array_distinct("tags")) == F.array_sort(F.array_distinct("want_tags"))
    fitting = models.join(wanted, KEYS).filter((F.col("window_size") == F.col("want_window")) & same_tags)
    columns = {c: ordered(c) for c in (*PARAMETERS, "err_mean", "err_std") if c in models.columns}
    if "coef" in models.columns:
        # Weights: an offset, then one per tag for each lag; rows and columns both follow the tags.
        lags = F.sequence(F.lit(0), F.col("window_size") - 1)
        weights = lambda r: F.flatten(F.transform(lags, lambda g: F.transform("place", lambda j: F.get(r, g * F.size("place") + j + 1))))
        columns["coef"] = F.transform(ordered("coef"), lambda r: F.concat(F.slice(r, 1, 1), weights(r)))
    fitting = fitting.withColumn("place", place).withColumns({**columns, "tags": F.col("want_tags")})
    return fitting.select(*models.columns)


#: Part of its terms below which a forecast error is rounding and none: an exact forecast has no error, in whatever order its sums were taken.
ROUNDING = 1e-12


def error_at(value: Column, prev: Column, i: Column) -> Column:
    """Absolute forecast error of the tag at position ``i`` of a row joined to its model."""
    shift, scale = F.get("norm_mean", i), F.get("norm_std", i)
    forecast = F.get("offset", i) + F.get("slope", i) * ((prev - shift) / scale)
    # A binary forecast is a probability.
    bounded = F.greatest(F.least(forecast, F.lit(1.0)), F.lit(0.0))
    forecast = F.when(F.get("tag_type", i) == "binary", bounded).otherwise(forecast)
    seen = (value - shift) / scale
    error = F.abs(seen - forecast)
    return F.when(error <= ROUNDING * (1 + F.abs(seen) + F.abs(forecast)), 0.0).otherwise(error)


def raw_errors(rows: DataFrame) -> DataFrame:
    """Add ``errors``, one per tag, to usable rows joined to their model."""
    return rows.withColumn("errors", F.transform("values", lambda v, i: error_at(v, F.get("prev", i), i)))


def error_stats(with_errors: DataFrame, keys: list[str] = VERSION) -> DataFrame:
    """Mean and floored population deviation of the normal error per tag."""
    cells = with_errors.select(*keys, F.posexplode("errors").alias("pos", "error"))
    stats = cells.groupBy(*keys, "pos").agg(
        F.avg("error").alias("err_mean"), F.coalesce(F.stddev_pop("error"), F.lit(0.0)).alias("spread")
    )
    return stats.withColumn("err_std", floored_std(F.col("err_mean"), F.col("spread"))).drop("spread")
