"""Registered queries: every operator over the whole event and line-item tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.functions.scalars import floored_std, normalized, parse_command, parse_duration
from millwatch.operators import control, inspection, model, parse, risk, scoring, snapshots
from millwatch.operators.train_hook import train_hook
from millwatch.plans.monitor import Settings, control_history, fit_models, monitor, monitor_history, score_rows, windowed_snapshots
from millwatch.session import configure, scratch_path, stage
from millwatch.sources import calibration, inspections, messages, models, volume
from millwatch.streaming import minutes, telemetry
from millwatch.streaming.state import BatchTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SETTINGS = Settings()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- shared inputs -----------------------------------------------------------------------


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_commands(volume.commands(spark, sf))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.asof_snapshot(volume.readings(spark, sf), volume.equipment_config(spark, sf))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_snapshots(volume.readings(spark, sf), volume.equipment_config(spark, sf), SETTINGS)


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot of an equipment as the training set of its version 0."""
    return stage(_windows(spark, sf), "windows").withColumns(
        {"model_version": F.lit(0).cast("long"), "fit": F.col("usable")}
    )


def _models(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    training = _training(spark, sf)
    return training, fit_models(training, volume.equipment_config(spark, sf))


def _intervals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    config, log = volume.equipment_config(spark, sf), _commands(spark, sf)
    rows = stage(_windows(spark, sf), "windows")
    attempts = control.train_attempts(rows, log, config)
    return rows, control.control_intervals(attempts, log, config)


def _samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, spans = _intervals(spark, sf)
    return calibration.calibration_samples(control.state_asof(rows, spans), volume.equipment_config(spark, sf)), spans


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.label_inspections(volume.inspections(spark, sf))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name)).alias(name)


# --- inspections -------------------------------------------------------------------------


@query
def inspection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the inspection rows as packed CSV in two column orders, plus files that must be skipped."""
    root = scratch_path(spark, "inspections")
    packed = {"header": True, "compression": "gzip"}
    rows = volume.inspections(spark, sf)
    even = F.col("INSP_TIME").cast("int") % 2 == 0
    rows.filter(even).write.options(**packed).csv(f"{root}/a")
    rows.filter(~even).select(*reversed(rows.columns)).write.options(**packed).csv(f"{root}/b")
    rows.drop("INSP_TIME").write.options(**packed).csv(f"{root}/c")
    found = inspections.inspection_scan(spark, [f"{root}/a/*.csv.gz", f"{root}/*/*.csv.gz"])
    measures = inspection.measure_columns(found)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in measures[1:]), F.coalesce(F.col(measures[0]), F.lit(0.0)))
    return found.select("series_id", "row_id", "INSP_DATE", "INSP_TIME", total.alias("total"))


@query
def inspection_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    rows = inspection.inspection_timestamp(volume.inspections(spark, sf))
    return rows.select("series_id", "row_id", _micros("inspected_at"))


@query
def scale_measures(spark: SparkSession, sf: str) -> DataFrame:
    rows = inspection.scale_measures(volume.inspections(spark, sf))
    return rows.select("series_id", "row_id", *inspection.measure_columns(rows))


@query
def tolerance_judge(spark: SparkSession, sf: str) -> DataFrame:
    rows = inspection.tolerance_judge(inspection.scale_measures(volume.inspections(spark, sf)))
    return rows.select("series_id", "row_id", F.col("is_ng").cast("long").alias("is_ng"))


@query
def minute_ng_count(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.minute_ng_count(_labelled(spark, sf))


@query
def gap_fill_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.gap_fill_minutes(_labelled(spark, sf)).select("series_id", "minute", F.col("ng").cast("long").alias("ng"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    rows = inspection.ml_feature_table(_labelled(spark, sf))
    return rounded(rows, 6, "ng_mean_30", "ng_std_30", "ng_slope_30", "ewma_gap").withColumns(
        {"target": F.col("target").cast("long"), "ng": F.col("ng").cast("long")}
    )


@query
def rolling_stats_30(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "ng_sum_30", "ng_mean_30", "ng_std_30", "ng_max_30")


@query
def trend_slope_30(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "ng_slope_30")


@query
def ewma_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "ewma_gap")


@query
def future_target(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "target")


@query
def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "part")


@query
def ml_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("series_id", "minute", "ng", *inspection.FEATURES, "target", "part")


@query
def class_weight(spark: SparkSession, sf: str) -> DataFrame:
    weights = inspection.class_weight(inspection.ml_feature_table(_labelled(spark, sf)))
    return rounded(weights, 9, "scale_pos_weight")


# Trees that SQL grows again.
EARLY_ROUNDS = 3


@query
def risk_train(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and class weight of a training run, and every node of its first three trees."""
    rows = stage(_features(spark, sf), "features")
    fitted = risk.risk_train(rows)
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if((F.col("part") == "train") & (F.col("target") == 1)).alias("n_positive"),
    ).first()
    nodes = rounded(fitted.first(EARLY_ROUNDS).nodes(spark), 6, "value")
    about = {**counts.asDict(), "scale_pos_weight": round(fitted.scale_pos_weight, 9)}
    return nodes.select("tree", "node", "feature", "cut", "n_rows", "value", *(F.lit(v).alias(k) for k, v in about.items()))


@query
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every minute's risk under a model of three rounds that went through storage; alarms at even odds, which so few rounds can reach."""
    rows = stage(_features(spark, sf), "features")
    path = scratch_path(spark, "risk-model")
    risk.risk_train(rows, EARLY_ROUNDS).first(EARLY_ROUNDS).save(spark, path)
    scored = risk.risk_score(risk.RiskModel.load(spark, path), rows, limit=0.5)
    return rounded(scored.select("series_id", "minute", "target", "risk", "alarm"), 6, "risk")


# --- messages and settings -----------------------------------------------------------------


@query
def message_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    messages.land_messages(volume.messages(spark, sf), path)
    return messages.message_scan(spark, path).select(
        "topic", F.octet_length("payload").cast("long").alias("payload_bytes"), _micros("received_at"), "offset"
    )


@query
def parse_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse.parse_records(volume.messages(spark, sf), volume.equipment_config(spark, sf))
    return rows.select("equipment_id", "tag", _micros("ts"), "value", "ord.offset", "ord.position")


@query
def route_and_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    entries = parse.record_entries(volume.messages(spark, sf))
    kept = parse.route_and_whitelist(entries, volume.equipment_config(spark, sf))
    return kept.groupBy("equipment_id", "topic", "tag").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_command_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = volume.commands(spark, sf)
    return rows.select("equipment_id", "ord", parse_command(F.col("payload")).alias("command"))


QUERIES["parse_command"] = QUERIES.pop("parse_command_words")


def _duration_text() -> Column:
    """Durations from part sizes: four good units, two bad ones, some with blanks around."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)


@query
def parse_duration_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = volume.table(spark, sf, "part")
    return rows.select("p_partkey", _duration_text().alias("text")).withColumn("seconds", parse_duration(F.col("text")))


QUERIES["parse_duration"] = QUERIES.pop("parse_duration_text")


@query
def config_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One settings row per customer; the key decides which rule it breaks."""
    key = F.col("c_custkey") % 13
    text = F.array().cast("array<string>")

    def unless(case: int, good: Column, bad: Column | None = None) -> Column:
        return F.when(key == case, bad).otherwise(good) if bad is not None else F.when(key != case, good)

    rows = volume.table(spark, sf, "customer").select(
        F.col("c_name").alias("equipment_id"),
        unless(1, unless(2, F.array(F.lit("plant/a")), text)).alias("subscribe_topics"),
        unless(3, F.lit("alarms/a")).alias("publish_topic"),
        F.lit("control/a").alias("command_topic"),
        unless(4, F.array(F.lit("a"), F.lit("b")), text).alias("tags"),
        unless(5, F.lit(50), F.lit(0)).alias("resample_interval_ms"),
        unless(6, unless(7, F.lit(100)), F.lit(-1)).alias("window_size"),
        unless(8, unless(9, F.lit("7d")), F.lit("7 days")).alias("max_duration"),
        unless(10, F.lit(10_000), F.lit(0)).alias("min_samples"),
    )
    checked = parse.config_rows(rows)
    return checked.select(
        "equipment_id", "valid", F.array_join("reasons", "; ").alias("reasons"), "max_duration_s"
    )


# --- snapshots and windows -----------------------------------------------------------------


@query
def asof_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = snapshots.asof_snapshot(volume.readings(spark, sf), volume.equipment_config(spark, sf), keep_empty=True)
    return snapshots.long_form(rows, volume.equipment_config(spark, sf))


@query
def drop_empty_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = snapshots.number_snapshots(_snapshots(spark, sf))
    return rows.select("equipment_id", "tick", "seq")


@query
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    config = volume.equipment_config(spark, sf)
    rows = snapshots.sliding_windows(snapshots.number_snapshots(_snapshots(spark, sf)), config)
    by_tag = rows.select(
        "equipment_id", "tick", "history", F.posexplode("target").alias("pos", "target")
    ).withColumn("history", F.array_join(F.transform("history", lambda v: F.format_string("%.2f", F.get(v, F.col("pos")))), ","))
    tags = config.select("equipment_id", "tags")
    return by_tag.join(tags, "equipment_id").select(
        "equipment_id", F.get("tags", F.col("pos")).alias("tag"), "tick", "history", "target"
    )


@query
def recent_n(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.recent_n(_snapshots(spark, sf), 100, 64).select("equipment_id", "tick")


# --- statistics, forecast, scores ------------------------------------------------------------


@query
def detect_tag_types(spark: SparkSession, sf: str) -> DataFrame:
    return model.detect_tag_types(_snapshots(spark, sf), volume.equipment_config(spark, sf))


@query
def normalization_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = model.normalization_stats(_snapshots(spark, sf), volume.equipment_config(spark, sf))
    return rounded(stats, 6, "mean", "std")


@query
def never_observed_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Every equipment is configured with one more tag than it sends."""
    config = volume.equipment_config(spark, sf)
    config = config.withColumn("tags", F.concat("tags", F.array(F.lit("ghost"))))
    rows = snapshots.asof_snapshot(volume.readings(spark, sf), config)
    return model.never_observed_tags(rows, config)


@query
def dtype_partition(spark: SparkSession, sf: str) -> DataFrame:
    config = volume.equipment_config(spark, sf)
    split = model.dtype_partition(model.detect_tag_types(_snapshots(spark, sf), config), config)
    return split.select(
        "equipment_id",
        F.array_join(F.col("continuous").cast("array<string>"), ",").alias("continuous"),
        F.array_join(F.col("binary").cast("array<string>"), ",").alias("binary"),
    )


@query
def stats_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each snapshot value with the statistics of its tag."""
    config = volume.equipment_config(spark, sf)
    rows = stage(_snapshots(spark, sf), "snapshots")
    stats = model.normalization_stats(rows, config)
    joined = snapshots.long_form(rows, config).join(stats, ["equipment_id", "tag"], "left")
    return rounded(joined, 6, "mean", "std").select("equipment_id", "tick", "tag", "value", "mean", "std")


@query
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    config = volume.equipment_config(spark, sf)
    rows = stage(_snapshots(spark, sf), "snapshots")
    stats = model.normalization_stats(rows, config)
    joined = snapshots.long_form(rows, config).join(stats, ["equipment_id", "tag"], "left")
    z = F.when(F.col("mean").isNotNull(), normalized(F.col("value"), F.col("mean"), F.col("std"))).otherwise(F.col("value"))
    return joined.select("equipment_id", "tick", "tag", F.round(z, 6).alias("value"))


@query
def std_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = volume.table(spark, sf, "events")
    mean, std = F.avg("value"), F.stddev_pop("value") / 100
    return rows.groupBy("user_id").agg(F.round(floored_std(mean, std), 9).alias("floored"))


@query
def forecast_fit(spark: SparkSession, sf: str) -> DataFrame:
    config = volume.equipment_config(spark, sf)
    fitted = model.with_tag_names(model.fit_forecaster(_training(spark, sf)), config)
    fitted = rounded(fitted, 6, "norm_mean", "norm_std", "slope", "offset")
    return fitted.select("equipment_id", "tag", "tag_type", "n_windows", "norm_mean", "norm_std", "slope", "offset")


@query
def forecast_fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Every weight of the window-wide forecaster: offset (lag 0) and one per lag and tag, of lines and logits."""
    fitted = fit_models(_training(spark, sf), volume.equipment_config(spark, sf), "linear")
    lines = fitted.select("equipment_id", "tags", "tag_type", F.posexplode("coef").alias("pos", "line"))
    cells = lines.select("equipment_id", "tags", "tag_type", "pos", F.posexplode("line").alias("at", "weight"))
    source = F.when(F.col("at") > 0, F.get("tags", (F.col("at") - 1) % F.size("tags")))
    return cells.select(
        "equipment_id",
        F.get("tags", F.col("pos")).alias("tag"),
        F.get("tag_type", F.col("pos")).alias("tag_type"),
        F.ceil(F.col("at") / F.size("tags")).cast("int").alias("lag"),
        source.alias("source"),
        F.round("weight", 4).alias("weight"),
    )


@query
def anomaly_score_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all usable snapshots under the window-wide forecaster."""
    config, training = volume.equipment_config(spark, sf), _training(spark, sf)
    fitted = stage(fit_models(training, config, "linear"), "linear-models")
    scored = score_rows(training.withColumn("target", F.col("usable")), fitted, config)
    return rounded(scored, 4, "anomaly_score").select("equipment_id", "tick", "anomaly_score")


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    training, fitted = _models(spark, sf)
    rows = training.filter("fit").select(*model.VERSION, "tick", "values", "prev")
    return model.raw_errors(rows.join(fitted, model.VERSION))


@query
def raw_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _errors(spark, sf).select("equipment_id", "tick", "tags", F.posexplode("errors").alias("pos", "error"))
    return rows.select("equipment_id", "tick", F.get("tags", F.col("pos")).alias("tag"), F.round("error", 6).alias("error"))


@query
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = model.error_stats(_errors(spark, sf))
    named = model.with_tag_names(stats, volume.equipment_config(spark, sf))
    return rounded(named, 6, "err_mean", "err_std").select("equipment_id", "tag", "err_mean", "err_std")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    training, fitted = _models(spark, sf)
    return score_rows(training.filter("usable"), fitted, volume.equipment_config(spark, sf))


@query
def anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf), 5, "anomaly_score").select("equipment_id", "tick", "anomaly_score")


@query
def anomaly_score_other_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores under models whose tags were stored in another order than the config has today.

    One equipment in four has since got another window size: its models are refused.
    """
    config = volume.equipment_config(spark, sf)
    training = _training(spark, sf)
    before = config.withColumn("tags", F.reverse("tags"))
    turned = training.withColumns({"values": F.reverse("values"), "prev": F.reverse("prev")})
    fitted = fit_models(turned, before)
    changed = F.substring("equipment_id", 3, 10).cast("int") % 4 == 0
    today = config.withColumn("window_size", F.when(changed, F.col("window_size") + 1).otherwise(F.col("window_size")))
    scored = score_rows(training.filter("usable"), fitted, today)
    return rounded(scored, 5, "anomaly_score").select("equipment_id", "tick", "anomaly_score")


@query
def top_deviant(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("equipment_id", "tick", "top_deviant_tag")


@query
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Raw values as scores: one series per user, a new model version every ten days."""
    rows = volume.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("equipment_id"),
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(864_000)).alias("model_version"),
        F.col("event_id").alias("tick"),
        F.col("value").alias("anomaly_score"),
    )
    return scoring.debounce(rows, threshold=20.0, confirm=3)


@query
def train_hook_means(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's functions: mean level of each tag over all samples, from sums and counts per bucket."""
    import numpy as np
    import pandas as pd

    def partial(group: pd.DataFrame) -> pd.DataFrame:
        stacked = np.array([[np.nan if v is None else v for v in row] for row in group["values"]], dtype=float)
        sums, counts = np.nansum(stacked, axis=0), (~np.isnan(stacked)).sum(axis=0)
        return pd.DataFrame({"equipment_id": group["equipment_id"].iloc[:1], "n": [len(group)], "sums": [sums], "counts": [counts]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        sums, counts = (np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("sums", "counts"))
        return pd.DataFrame({"equipment_id": rows["equipment_id"].iloc[:1].to_numpy(), "n": [rows["n"].sum()], "sums": [sums], "counts": [counts]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        level = [float(np.round(s / c, 6)) if c else None for s, c in zip(rows["sums"].iloc[0], rows["counts"].iloc[0])]
        return pd.DataFrame({"equipment_id": rows["equipment_id"], "n": rows["n"], "level": [level]})

    partials = "equipment_id string, n long, sums array<double>, counts array<long>"
    rows = train_hook(_snapshots(spark, sf), partial, partials, merge, finish, "equipment_id string, n long, level array<double>", size=64)
    return rows.select("equipment_id", "n", F.posexplode("level").alias("pos", "level"))


QUERIES["train_hook"] = QUERIES.pop("train_hook_means")


# --- control, stored state, the whole chain ---------------------------------------------------


@query
def train_gate(spark: SparkSession, sf: str) -> DataFrame:
    counts = calibration.calibration_count(_samples(spark, sf)[0])
    return control.train_gate(counts, volume.equipment_config(spark, sf))


@query
def train_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Why each train is refused, where every equipment is configured with one more tag than it sends."""
    config, log = volume.equipment_config(spark, sf), _commands(spark, sf)
    config = config.withColumn("tags", F.concat("tags", F.array(F.lit("ghost"))))
    rows = stage(windowed_snapshots(volume.readings(spark, sf), config, SETTINGS), "windows")
    attempts = stage(control.train_attempts(rows, log, config), "attempts")
    named = control.unseen_tags(attempts, rows, config)
    return named.select("equipment_id", "episode", "tick", "n_samples", "reason", F.array_join("unseen_tags", ",").alias("unseen_tags"))


@query
def control_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return _intervals(spark, sf)[1]


@query
def settings_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """State intervals of machines whose settings change half-way."""
    return control_history(volume.readings(spark, sf), _commands(spark, sf), volume.settings_history(spark, sf), SETTINGS)


@query
def settings_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and alarms of machines whose settings change half-way."""
    rows = monitor_history(volume.readings(spark, sf), _commands(spark, sf), volume.settings_history(spark, sf), SETTINGS)
    return rounded(rows, 4, "anomaly_score")


@query
def state_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows, spans = _intervals(spark, sf)
    return control.state_asof(rows.select("equipment_id", "tick"), spans).select(
        "equipment_id", "tick", "state", "episode", "model_version"
    )


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored state words by equipment: some good, some unreadable, some missing."""
    config = volume.equipment_config(spark, sf)
    n = F.substring("equipment_id", 3, 10).cast("int") % 4
    word = F.when(n == 0, "MONITORING").when(n == 1, " MONITORING\n").when(n == 2, "garbled")
    return config.select("equipment_id", word.alias("state")).filter(F.col("state").isNotNull())


@query
def state_table(spark: SparkSession, sf: str) -> DataFrame:
    return control.state_table(_stored(spark, sf), volume.equipment_config(spark, sf))


def _stored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models of three vintages: same settings, another window, other tags."""
    n = F.substring("equipment_id", 3, 10).cast("int") % 3
    config = volume.equipment_config(spark, sf)
    return config.select(
        "equipment_id",
        n.cast("long").alias("model_version"),
        F.when(n == 1, F.lit(12)).otherwise(F.col("window_size")).alias("window_size"),
        F.when(n == 2, F.slice("tags", 1, 4)).otherwise(F.reverse("tags")).alias("tags"),
    )


@query
def model_compat(spark: SparkSession, sf: str) -> DataFrame:
    return control.model_compat(_stored_models(spark, sf), volume.equipment_config(spark, sf))


@query
def resume_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return control.resume_or_fallback(_stored(spark, sf), _stored_models(spark, sf), volume.equipment_config(spark, sf))


@query
def calibration_append(spark: SparkSession, sf: str) -> DataFrame:
    """Every third sample is appended twice and counts once."""
    path = scratch_path(spark, "samples")
    samples = stage(_samples(spark, sf)[0], "samples")
    calibration.calibration_append(samples, path)
    calibration.calibration_append(samples.filter("tick % 3 = 0"), path)
    return calibration.calibration_table(spark, path).select("equipment_id", "episode", "tick")


@query
def calibration_read(spark: SparkSession, sf: str) -> DataFrame:
    """Samples through JSON lines, after damaged lines were added next to the good ones."""
    path = scratch_path(spark, "sample-lines")
    config = volume.equipment_config(spark, sf)
    samples = stage(_samples(spark, sf)[0], "samples")
    calibration.calibration_export(samples, config, path)
    damaged = samples.select(
        "equipment_id",
        F.when(F.col("tick") % 3 == 0, '{"timestamp": "2024-01-')
        .when(F.col("tick") % 3 == 1, '{"values": {"click": 1.0}}')
        .otherwise("")
        .alias("value"),
    )
    damaged.write.mode("append").partitionBy("equipment_id").text(path)
    rows = calibration.calibration_read(spark, path)
    return rows.select("equipment_id", _micros("ts"), F.explode("values").alias("tag", "value"))


@query
def calibration_count(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.calibration_count(_samples(spark, sf)[0])


@query
def calibration_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot as a stored sample; what the files hold after a prune at each equipment's last reading."""
    config, path = volume.equipment_config(spark, sf), scratch_path(spark, "samples")
    rows = _snapshots(spark, sf).join(config.select("equipment_id", "resample_interval_ms"), "equipment_id")
    at = calibration.sample_time(F.col("tick"), F.col("resample_interval_ms")).alias("ts")
    calibration.calibration_append(rows.select("equipment_id", F.lit(0).cast("long").alias("episode"), "tick", at, "values"), path)
    now = volume.readings(spark, sf).groupBy("equipment_id").agg(F.max("ts").alias("now"))
    calibration.prune_store(spark, path, config, now)
    return spark.read.schema(calibration.STORED_SCHEMA).parquet(path).select("equipment_id", "tick")


@query
def calibration_clear(spark: SparkSession, sf: str) -> DataFrame:
    """What the files hold after a clear."""
    samples, spans = _samples(spark, sf)
    path = scratch_path(spark, "samples")
    calibration.calibration_append(samples, path)
    calibration.calibration_rewrite(spark, path, lambda stored: calibration.calibration_clear(stored, spans))
    return spark.read.schema(calibration.STORED_SCHEMA).parquet(path).select("equipment_id", "episode", "tick")


def _saved(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "models")
    models.model_save(_models(spark, sf)[1], path)
    return path


@query
def model_save(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.model_load(spark, _saved(spark, sf), newest=False)
    return rows.select("equipment_id", "model_version", "window_size", F.size("tags").alias("n_tags"))


@query
def model_load(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under a model that went through storage."""
    training = _training(spark, sf)
    path = scratch_path(spark, "models")
    models.model_save(fit_models(training, volume.equipment_config(spark, sf)), path)
    scored = score_rows(training.filter("usable"), models.model_load(spark, path), volume.equipment_config(spark, sf))
    return rounded(scored, 5, "anomaly_score").select("equipment_id", "tick", "anomaly_score")


def run_monitor(spark: SparkSession, sf: str) -> DataFrame:
    return monitor(
        volume.readings(spark, sf), _commands(spark, sf), volume.equipment_config(spark, sf), SETTINGS
    )


@query
def monitor_alarms(spark: SparkSession, sf: str) -> DataFrame:
    rows = rounded(run_monitor(spark, sf), 4, "anomaly_score")
    return rows.select("equipment_id", "model_version", "tick", "anomaly_score", "top_deviant_tag", "alarm")


@query
def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Raw event values as scores, so the message text does not depend on float noise."""
    rows = volume.event_rows(spark, sf).select(
        "equipment_id",
        F.col("ord").alias("tick"),
        F.round("value", 2).alias("anomaly_score"),
        (F.col("k") >= 90).alias("alarm"),
        F.col("tag").alias("top_deviant_tag"),
    )
    sent = scoring.result_envelope(rows, volume.equipment_config(spark, sf), "edge")
    record = F.from_json("payload", "records array<map<string,string>>").getField("records")[0]
    return sent.select(
        "topic",
        F.map_values(record)[0].alias("sent_at"),
        F.array_join(F.map_keys(record), ",").alias("fields"),
        F.map_values(record)[1].cast("double").alias("anomaly_score"),
        F.map_values(record)[2].alias("alarm"),
        F.map_values(record)[3].alias("top_deviant_tag"),
    )


# --- streams: the whole table lands in three parts, each part is one run of the stream -----------------

PARTS = 3


def _run_in_parts(rows: DataFrame, at: str, start: Callable[[DataFrame, int], StreamingQuery], shuffled: bool = False) -> str:
    """Land ``rows`` in parts and let a restarted stream catch up after each. ``start`` also gets a part's span in ms.

    Parts follow in time; ``shuffled`` makes every third row arrive one part later than its time.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "landed")
    rows = stage(rows, "source")
    lo, hi = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    part = F.least(F.floor((F.unix_micros(at) - lo) * PARTS / (hi - lo + 1)), F.lit(PARTS - 1))
    if shuffled:
        part = F.least(part + F.when(F.col("ord") % 3 == 0, 1).otherwise(0), F.lit(PARTS - 1))
    for i in range(PARTS):
        rows.filter(part == i).write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path), (hi - lo) // (1000 * PARTS) + 1000).awaitTermination()
    return path


def _stream_snapshots(spark: SparkSession, sf: str, on_snapshots=None) -> BatchTables:
    root = scratch_path(spark, "snapshot-stream")
    config = volume.equipment_config(spark, sf)
    _run_in_parts(
        volume.readings(spark, sf),
        "ts",
        lambda rows, delay: telemetry.stream_snapshots(
            rows, lambda: config, root, delay, on_snapshots=on_snapshots, availableNow=True
        ),
        shuffled=True,
    )
    return BatchTables(spark, root)


@query
def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    tables = _stream_snapshots(spark, sf)
    rows = tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA)
    flat = snapshots.long_form(rows, volume.equipment_config(spark, sf))
    usable = rows.select("equipment_id", "tick", "seq", "usable")
    return flat.join(usable, ["equipment_id", "tick"])


@query
def stream_silent_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of a stream in which two of three machines fall silent half-way, while beats of the clock go on."""
    root = scratch_path(spark, "silent-stream")
    config = volume.equipment_config(spark, sf)
    rows = volume.readings(spark, sf).withColumn("received_at", F.col("ts"))
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    heard = (F.substring("equipment_id", 3, 10).cast("int") % 3 == 0) | (F.unix_micros("ts") < (lo + hi) // 2)
    sent = telemetry.with_heartbeats(rows.filter(heard), rows.select("received_at"))
    _run_in_parts(
        sent,
        "received_at",
        lambda stream, _: telemetry.stream_snapshots(stream, lambda: config, root, 0, availableNow=True),
    )
    flat = snapshots.long_form(BatchTables(spark, root).all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA), config)
    return flat.select("equipment_id", "tick", "tag", "value")


@query
def stream_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the live stream under models fitted beforehand on the whole history."""
    config = volume.equipment_config(spark, sf)
    fitted = stage(_models(spark, sf)[1], "models")

    def score(rows: DataFrame, tables: BatchTables, batch: int) -> None:
        telemetry.monitor_step(rows, None, fitted, config, tables, batch)

    tables = _stream_snapshots(spark, sf, score)
    rows = rounded(tables.all_batches("alarms", telemetry.ALARM_SCHEMA), 4, "anomaly_score")
    return rows.select("equipment_id", "tick", "anomaly_score", "top_deviant_tag", "alarm")


@query
def stream_control(spark: SparkSession, sf: str) -> DataFrame:
    config = volume.equipment_config(spark, sf)
    history = _stream_snapshots(spark, sf).all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA)
    root = scratch_path(spark, "control-stream")
    _run_in_parts(
        _commands(spark, sf),
        "ts",
        lambda rows, _: telemetry.stream_control(rows, lambda: history, lambda: config, root, availableNow=True),
    )
    return BatchTables(spark, root).read("intervals", PARTS - 1, telemetry.INTERVAL_SCHEMA)


def _sent(envelopes: DataFrame) -> DataFrame:
    """The fields of published messages, under plain names."""
    record = F.from_json("payload", "records array<map<string,string>>").getField("records")[0]
    field = lambda name: record.getItem(f"edge:{name}")
    return envelopes.select(
        "equipment_id",
        "tick",
        F.round(field("anomaly_score").cast("double"), 4).alias("anomaly_score"),
        field("alarm").cast("boolean").alias("alarm"),
        field("top_deviant_tag").alias("top_deviant_tag"),
    )


@query
def message_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job in one batch: raw messages and commands in, published messages out."""
    config = volume.equipment_config(spark, sf)
    readings = parse.parse_records(volume.messages(spark, sf), config)
    alarms = monitor(readings, _commands(spark, sf), config, SETTINGS)
    return _sent(scoring.result_envelope(alarms, config, "edge"))


@query
def stream_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job as a stream: readings out of order, trains, model switches, published messages."""
    root = scratch_path(spark, "pipeline-stream")
    config, log = volume.equipment_config(spark, sf), _commands(spark, sf)
    _run_in_parts(
        volume.readings(spark, sf),
        "ts",
        lambda rows, delay: telemetry.stream_pipeline(
            rows, lambda: log, lambda: config, root, delay, "edge", availableNow=True
        ),
        shuffled=True,
    )
    return _sent(BatchTables(spark, root).all_batches("envelopes", telemetry.ENVELOPE_SCHEMA))


def _stream_minutes(spark: SparkSession, sf: str, on_features=None) -> BatchTables:
    root = scratch_path(spark, "minute-stream")
    labelled = _labelled(spark, sf).select("series_id", "inspected_at", "is_ng")
    _run_in_parts(
        labelled,
        "inspected_at",
        lambda rows, _: minutes.stream_minute_features(rows, root, "0 seconds", on_features, availableNow=True),
    )
    return BatchTables(spark, root)


@query
def stream_minute_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream_minutes(spark, sf).all_batches("features", minutes.FEATURE_SCHEMA)
    return rounded(rows, 6, "ng_mean_30", "ng_std_30", "ng_slope_30", "ewma_gap")


@query
def stream_minute_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third inspection arrives one part late and corrects what was given out; the last revisions are the batch table."""
    root = scratch_path(spark, "change-stream")
    labelled = _labelled(spark, sf).select("series_id", "inspected_at", "is_ng")
    labelled = labelled.withColumn("ord", F.crc32(F.concat("series_id", F.col("inspected_at").cast("string")).cast("binary")))
    _run_in_parts(
        labelled,
        "inspected_at",
        lambda rows, span: minutes.stream_minute_changes(rows, root, 2 * span // 60_000 + 1, availableNow=True),
        shuffled=True,
    )
    rows = minutes.latest_features(BatchTables(spark, root)).drop("revision")
    return rounded(rows, 6, "ng_mean_30", "ng_std_30", "ng_slope_30", "ewma_gap")


@query
def stream_minute_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of each finished minute of the stream under a model of three rounds trained on the whole history."""
    step = minutes.risk_step(risk.risk_train(stage(_features(spark, sf), "features"), EARLY_ROUNDS).first(EARLY_ROUNDS))
    alike = lambda rows, tables, batch: step(rounded(rows, 6, "ng_mean_30", "ng_std_30", "ng_slope_30", "ewma_gap"), tables, batch)
    rows = _stream_minutes(spark, sf, alike).all_batches("risk", minutes.RISK_SCHEMA)
    return rounded(rows.select("series_id", "minute", "risk", "alarm"), 6, "risk")


def all_queries() -> dict[str, Query]:
    def wrap(fn: Query) -> Query:
        return lambda spark, sf: fn(configure(spark), sf)

    return {name: wrap(fn) for name, fn in QUERIES.items()}
